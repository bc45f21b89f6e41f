"""Group comparisons: joint index, rank tests, false-discovery rates, descriptives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.numeric import normal_cdf
from pairforge.operators.scaling import (
    null_safe_join,
    exact_quantiles,
    following_minimum,
    mid_ranks,
    running_totals,
    salted_join,
)


def joint_index(df: DataFrame, cohort: str, first: str, second: str) -> DataFrame:
    """Tie-averaged rank share of both measures within the cohort, and their mean.

    The share is rank / (n + 1); the joint index is the geometric mean of the two.
    """
    out = df
    for value in (first, second):
        ranks = mid_ranks(df, [cohort], value).select(
            cohort, value, (F.col("mid_rank") / (F.col("n_all") + 1)).alias(f"{value}_percentile")
        )
        out = salted_join(out, ranks, [cohort, value], how="left")
    return out.withColumn(
        "joint_index", F.sqrt(F.col(f"{first}_percentile") * F.col(f"{second}_percentile"))
    )


def rank_test(
    values: DataFrame, group: Sequence[str] = ("dataset", "metric")
) -> DataFrame:
    """Mann-Whitney U of label 0 against label 1, two-sided p, rank-biserial effect.

    Normal approximation with tie and continuity correction. Rows collapse to distinct
    values before any shuffle on the group.
    """
    keys = list(group)
    counted = values.where(F.col("value").isNotNull()).groupBy(*keys, "value", "y_true").agg(
        F.count(F.lit(1)).alias("n")
    )
    ranks = mid_ranks(values, keys, "value")
    zero = F.when(F.col("y_true") == 0, F.col("n")).otherwise(0)
    rank_sum = (
        counted.join(ranks.select(*keys, "value", "mid_rank"), [*keys, "value"])
        .groupBy(*keys)
        .agg(
            F.sum(zero * F.col("mid_rank")).alias("_r0"),
            F.sum(zero).cast("double").alias("_n0"),
            F.sum(F.col("n") - zero).cast("double").alias("_n1"),
        )
    )
    ties = ranks.groupBy(*keys).agg(
        F.sum(F.pow(F.col("n_equal").cast("double"), 3) - F.col("n_equal")).alias("_ties")
    )
    n0, n1 = F.col("_n0"), F.col("_n1")
    n = n0 + n1
    u = F.col("_r0") - n0 * (n0 + 1) / 2.0
    spread = F.sqrt(n0 * n1 / 12.0 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    z = (F.abs(u - n0 * n1 / 2.0) - 0.5) / F.nullif(spread, F.lit(0.0))
    table = rank_sum.join(ties, keys).select(
        *keys,
        n0.cast("bigint").alias("n_0"),
        n1.cast("bigint").alias("n_1"),
        u.alias("u"),
        (2.0 * u / F.nullif(n0 * n1, F.lit(0.0)) - 1.0).alias("rank_biserial"),
        F.greatest(z, F.lit(0.0)).alias("z"),
    )
    return table.withColumn("p_value", F.least(F.lit(1.0), 2.0 * normal_cdf(-F.col("z"))))


def false_discovery(
    tests: DataFrame, keys: Sequence[str], family: Sequence[str] = (), p: str = "p_value"
) -> DataFrame:
    """Benjamini-Hochberg q-values within each family of tests."""
    group = list(family) or ["_family"]
    rows = tests if family else tests.withColumn("_family", F.lit(0))
    ranked = running_totals(rows, group, [p, *keys], {"_n": F.lit(1)})
    stepped = ranked.withColumn("_step", F.col(p) * F.col("_n_all") / (F.col("_n_before") + 1))
    best = following_minimum(stepped, group, [p, *keys], "_step", "_best")
    return best.withColumn("q_value", F.least(F.lit(1.0), "_best")).select(*tests.columns, "q_value")


def describe(
    values: DataFrame, group: Sequence[str] = ("dataset", "metric", "y_true")
) -> DataFrame:
    """Mean, standard deviation and exact quartiles per group."""
    moments = values.groupBy(*group).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )
    quartiles = exact_quantiles(values, group, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return null_safe_join(moments, quartiles, list(group), "left")


def covariance_ellipse(
    df: DataFrame, group: Sequence[str], x: str, y: str, minimum: int = 5
) -> DataFrame:
    """Centre, full axis widths and angle of the covariance ellipse per group."""
    a, b, c = F.col("_vx"), F.col("_vy"), F.col("_cxy")
    half, gap = (a + b) / 2.0, F.sqrt(F.pow((a - b) / 2.0, 2) + c * c)

    def axis(value: Column) -> Column:
        return 2.0 * F.sqrt(F.greatest(value, F.lit(0.0)))

    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(x).alias("center_x"),
            F.avg(y).alias("center_y"),
            F.var_samp(x).alias("_vx"),
            F.var_samp(y).alias("_vy"),
            F.covar_samp(x, y).alias("_cxy"),
        )
        .where(F.col("n") >= minimum)
        .select(
            *group,
            "n",
            "center_x",
            "center_y",
            axis(half + gap).alias("width"),
            axis(half - gap).alias("height"),
            F.degrees(F.atan2(2.0 * c, a - b) / 2.0).alias("angle"),
        )
    )
