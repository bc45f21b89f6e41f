"""Building blocks that keep order statistics and joins exact when one key is hot.

A window partitioned by a hot key puts the whole group into one task. The helpers
here range-partition the rows instead, so a group spreads over many slices, and stitch
the slices together with one small row of totals per (group, slice).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, from ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder; on a cluster a missing
    setting is an error, because executors need a shared place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder, read again: computed once, read by column."""
    path = f"{checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCAN_ROWS = 50_000  # rows of a scan that a task makes many of


def spread(scan: DataFrame) -> DataFrame:
    """Deal an input of few splits to all cores and to tasks of at most about ``SCAN_ROWS`` rows.

    For heavy per-row work right after a read, where a split of a well compressed file may hold
    millions of rows. A scan with enough splits stays as it is. Pass a scan, not a shuffled result.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, ceil(scan.count() / SCAN_ROWS))
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


SLICE_ROWS = 500_000  # rows of a slice whose number is chosen by ``slice_count``, about


def slice_count(df: DataFrame) -> int:
    """Slices of about ``SLICE_ROWS`` rows, for input that is cheap to count."""
    return max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / SLICE_ROWS))


def slices(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], parts: int | None = None
) -> DataFrame:
    """Range-partition by group and order, tag rows with ``_slice``, make durable.

    Slices of a group follow its order: all rows of a lower slice come first. The
    checkpoint fixes the boundaries, which a recomputation could move. Without ``parts``
    their number follows the shuffled bytes. Rows that are many enough to be given ``parts`` are
    cut as Parquet, which holds them in a fraction of a checkpoint's bytes.
    """
    if parts is None:
        return durable(df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id()))
    return written(df.repartitionByRange(parts, *group, *order).withColumn("_slice", F.spark_partition_id()))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left join on equal columns where NULL equals NULL, so that NULL groups stay."""
    named = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(named, same, how).drop(*[f"_right_{c}" for c in on])


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, Column],
    parts: int | None = None,
) -> DataFrame:
    """Exclusive running sums of ``totals`` in ``order`` within ``group``.

    Adds ``<name>_before`` and ``<name>_all`` (the group total) for every entry. The
    order should be unique within the group, or equal rows swap places at will.
    """
    for name, value in totals.items():
        df = df.withColumn(name, value)
    rows = slices(df, group, order, parts)
    per_slice = rows.groupBy(*group, "_slice").agg(*[F.sum(n).alias(n) for n in totals])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy(*group)
    heads = per_slice.select(
        *group,
        "_slice",
        F.lit(False).alias("_row"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}_offset") for n in totals],
        *[F.sum(n).over(everything).alias(f"{n}_all") for n in totals],
    )
    # A slice's totals go ahead of its rows as one more row, so that no join has to deal them again.
    headed = rows.withColumn("_row", F.lit(True)).unionByName(heads, allowMissingColumns=True)
    if parts is not None:  # some tasks get several slices by their hash
        headed = headed.repartition(2 * parts, *group, "_slice")
    inside = Window.partitionBy(*group, "_slice").orderBy("_row", *order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = headed.select(
        *rows.columns,
        "_row",
        *[
            (F.first(f"_{n}_offset", ignorenulls=True).over(inside) + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before")
            for n in totals
        ],
        *[F.first(f"{n}_all", ignorenulls=True).over(inside).alias(f"{n}_all") for n in totals],
    )
    return placed.where("_row").drop("_slice", "_row")


def placed_values(
    df: DataFrame, group: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Distinct values per group with ``_n`` copies and ``_n_before`` smaller rows.

    Equal values are counted before the shuffle; NULL values are skipped. ``weight``
    names an integer column of repetitions when rows are already counted. The result
    rests on a checkpoint, so several consumers do not repeat the input's work.
    """
    repeats = F.lit(1) if weight is None else F.col(weight)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_value"))
        .agg(F.sum(repeats).alias("_n"))
    )
    return running_totals(counted, group, ["_value"], {"_n": F.col("_n")})


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one named column each."""
    return pick_quantiles(placed_values(df, group, value, weight), group, probabilities)


def pick_quantiles(
    placed: DataFrame, group: Sequence[str], probabilities: Mapping[str, float]
) -> DataFrame:
    """Quantiles from ``placed_values``: the order statistics at the two nearest ranks."""

    def value_at(rank: Column) -> Column:
        inside = (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(inside, F.col("_value")))

    picks = [F.max("_n_all").alias("_size")]
    for name, p in probabilities.items():
        rank = F.lit(p) * (F.col("_n_all") - 1)
        picks += [
            value_at(F.floor(rank)).alias(f"_lo_{name}"),
            value_at(F.ceil(rank)).alias(f"_hi_{name}"),
        ]
    output = []
    for name, p in probabilities.items():
        rank = F.lit(p) * (F.col("_size") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        output.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    return placed.groupBy(*group).agg(*picks).select(*group, *output)


def mid_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value: ``n_equal``, its tie-averaged ``mid_rank``, ``n_all``."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("n_equal"))
    )
    placed = running_totals(counted, group, [value], {"n_equal": F.col("n_equal")})
    return placed.select(
        *group,
        value,
        "n_equal",
        (F.col("n_equal_before") + (F.col("n_equal") + 1) / 2.0).alias("mid_rank"),
        F.col("n_equal_all").alias("n_all"),
    )


def following_minimum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Minimum of ``value`` over the current and all later rows of the group's order."""
    rows = slices(df, group, order)
    later = Window.partitionBy(*group).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    tails = rows.groupBy(*group, "_slice").agg(F.min(value).alias("_low")).select(
        *group, "_slice", F.min("_low").over(later).alias("_later")
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(
        0, Window.unboundedFollowing
    )
    local = rows.withColumn("_local", F.min(value).over(inside))
    # least() skips NULL, which marks the last slice of a group.
    return (
        null_safe_join(local, tails, [*group, "_slice"])
        .withColumn(name, F.least("_local", "_later"))
        .drop("_slice", "_local", "_later")
    )


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salts: int = 8,
) -> DataFrame:
    """Equi-join that spreads each key of ``big`` over ``salts`` tasks.

    ``small`` must be unique on the key; each of its rows is repeated once per salt.
    Supports inner and left joins, whose unmatched rows stem from ``big`` only.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(big)), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    """Columns that tell the rows of a hot key apart (maps cannot be hashed)."""
    return [name for name, kind in df.dtypes if "map<" not in kind]


GROUP_LIMIT = 1000  # default of spark.sql.optimizer.windowGroupLimitThreshold


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str) -> DataFrame:
    """First ``k`` rows per group with their 1-based rank. The order should be total.

    Spark prunes every map task to ``k`` rows per group before the shuffle, so a hot
    group reaches its task with at most ``k`` rows per upstream partition. Beyond the
    size Spark prunes for, rows are ranked over range slices instead.
    """
    if k > GROUP_LIMIT:
        placed = running_totals(df, group, order, {"_one": F.lit(1)})
        ranked = placed.withColumn(rank, (F.col("_one_before") + 1).cast("int"))
        return ranked.where(F.col(rank) <= k).drop("_one", "_one_before", "_one_all")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
