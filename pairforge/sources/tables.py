"""Readers with explicit schemas and contracts, and writers."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.contracts import missing_columns, require
from pairforge.operators.scaling import running_totals
from pairforge.plans.pairing import MINIMAL

CANDIDATE_SCHEMA = (
    "source_id bigint, label int, prompt_route string, candidate_index int, "
    "generation_trial int, candidate_text string"
)
PREDICTION_COLUMNS = (
    "dataset",
    "unit",
    "method",
    "family",
    "method_group",
    "weight_id",
    "aug_seed",
    "train_seed",
    "y_true",
    "y_pred",
    "y_prob",
)
BOM = "﻿"


def labelled_table(
    df: DataFrame,
    text: str = "text1",
    label: str = "label",
    key: str = "source_id",
    order: Sequence[str] = (),
) -> DataFrame:
    """Check and normalise a source table to ``(source_id, text1, label, ...)``.

    A missing id becomes the row number: ``order`` names columns that fix the row order,
    because a distributed table has none of its own.
    """
    missing = missing_columns(df, [text, label])
    if missing:
        raise ValueError(f"missing columns {missing}")
    rows = df.withColumn(text, F.col(text).cast("string")).withColumn(
        label, F.col(label).cast("int")
    )
    bad = rows.where(F.col(label).isNull() | ~F.col(label).isin(0, 1)).select(label)
    require(bad, "labels must be 0 or 1")
    if key not in df.columns:
        if not order:
            raise ValueError("a generated id needs order columns")
        rows = with_row_number(rows, order, key)
    return rows.withColumnsRenamed({text: "text1", label: "label", key: "source_id"})


def with_row_number(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based row number in a total order, without one global window."""
    placed = running_totals(df.withColumn("_all", F.lit(0)), ["_all"], order, {"_n": F.lit(1)})
    return placed.withColumn(name, F.col("_n_before")).drop("_all", "_n", "_n_before", "_n_all")


def read_labelled_csv(spark: SparkSession, path: str, schema: str, **columns) -> DataFrame:
    return labelled_table(
        spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True, multiLine=True),
        **columns,
    )


def read_candidates(spark: SparkSession, path: str, schema: str = CANDIDATE_SCHEMA) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones fail."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


REGION_ITEMS = "array<struct<name:string,bbox:array<double>,sam_score:double,prompt:string>>"


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Region inventory: a JSON list, or an object with ``information_units`` or ``ius``.

    Every box needs four numbers; a missing name becomes ``IU_<position>``.
    """
    content = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    wrapped = F.from_json("value", f"information_units {REGION_ITEMS}, ius {REGION_ITEMS}")
    listed = F.when(F.col("value").startswith("["), F.from_json("value", REGION_ITEMS)).otherwise(
        F.coalesce(wrapped["information_units"], wrapped["ius"])
    )
    rows = content.select(F.posexplode_outer(listed).alias("position", "item"))
    require(rows.where(F.col("position").isNull()).limit(1), "the region inventory is empty")
    require(
        rows.where(F.col("item.bbox").isNull() | (F.size("item.bbox") != 4)).select("position"),
        "a region needs a box of four numbers",
    )
    name = F.coalesce("item.name", F.concat(F.lit("IU_"), F.col("position")))
    return rows.select("position", name.alias("name"), "item.bbox", "item.sam_score", "item.prompt")


def read_manifest(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV of strings: byte-order mark tolerated, required columns checked, not empty."""
    df = spark.read.csv(path, header=True, multiLine=True)
    df = df.toDF(*[c.lstrip(BOM).strip('"') for c in df.columns])
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns {missing}")
    if df.isEmpty():
        raise ValueError("the manifest is empty")
    return df


def read_pairs(df: DataFrame) -> DataFrame:
    """Preference pairs: the four required columns, binary labels, not empty."""
    missing = missing_columns(df, MINIMAL)
    if missing:
        raise ValueError(f"missing columns {missing}")
    if df.isEmpty():
        raise ValueError("the pair table is empty")
    require(df.where(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))), "labels must be 0 or 1")
    return df


def prediction_lock(df: DataFrame, datasets: Sequence[str], methods: Sequence[str]) -> DataFrame:
    """The prediction columns of known cohorts and methods; filters reach the scan."""
    return df.where(F.col("dataset").isin(*datasets) & F.col("method").isin(*methods)).select(
        *PREDICTION_COLUMNS
    )


def write_table(
    df: DataFrame, path: str, file_format: str = "parquet", columns: Sequence[str] = (), compression: str | None = None
) -> None:
    """Write parquet, csv or json; ``columns`` picks a subset such as the minimal pairs.

    ``compression`` is the format's own by default. A csv of several lines a row is read by one task
    a file anyway, so ``gzip`` costs it no splits.
    """
    out = df.select(*columns) if columns else df
    writer = out.write.mode("overwrite")
    if compression is not None:
        writer.option("compression", compression)
    if file_format == "csv":
        writer.option("escape", '"').csv(path, header=True)
    elif file_format in ("parquet", "json"):
        writer.format(file_format).save(path)
    else:
        raise ValueError(f"unsupported format {file_format!r}")


def write_summary(spark: SparkSession, path: str, facts: Mapping[str, object]) -> None:
    """One-row run record next to an output."""
    row = spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string")
    row.write.mode("overwrite").text(path)

