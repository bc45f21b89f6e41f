"""Scoring of a candidate table against its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.vectors import cosine
from pairforge.operators.bands import class_statistics, evaluate_candidates, with_bands
from pairforge.operators.residual import fit_projection, residual_cosine
from pairforge.operators.scaling import durable, salted_join
from pairforge.settings import ScoringSettings


def score_candidates(
    sources: DataFrame,
    candidates: DataFrame,
    settings: ScoringSettings = ScoringSettings(),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Score every candidate of a known source.

    ``sources(source_id, label, breadth, depth, vec, ...)`` unique on ``source_id``;
    ``candidates(source_id, candidate_y, candidate_z, candidate_vec, ...)``. The join is
    salted because one source may own a large share of the candidates. Source columns
    in ``carry`` (such as the text) travel along.
    """
    # Read three times below; its coverage may rest on an aggregate over all regions.
    base = durable(sources.select("source_id", "label", "breadth", "depth", "vec", *carry))
    projection = fit_projection(base)
    banded = with_bands(base, class_statistics(base, settings), settings)
    side = banded.select(
        "source_id",
        "label",
        "breadth",
        "depth",
        *[f"eps_{axis}_{way}" for axis in "yz" for way in ("plus", "minus")],
        *[f"{axis}_{end}" for axis in "yz" for end in ("lower", "upper")],
        F.col("vec").alias("_source_vec"),
        *carry,
    )
    joined = salted_join(candidates, side, ["source_id"])
    measured = joined.withColumn(
        "residual_cos",
        residual_cosine(projection, F.col("_source_vec"), F.col("candidate_vec")),
    ).withColumn("origin_cos", cosine("_source_vec", "candidate_vec"))
    return (
        evaluate_candidates(measured, settings)
        .withColumnRenamed("breadth", "source_y")
        .withColumnRenamed("depth", "source_z")
        .drop(
            "_source_vec",
            "candidate_vec",
            *[f"eps_{axis}_{way}" for axis in "yz" for way in ("plus", "minus")],
        )
    )
