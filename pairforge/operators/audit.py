"""Roll-ups of audited candidates, method summaries and distance-to-reference tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.numeric import ratio, student_two_sided
from pairforge.operators.scaling import exact_quantiles, mid_ranks, salted_join

FILE = ("method", "seed")
MEASURES = {
    "yz_violation": "yz_violation_score",
    "x_violation": "x_violation_score",
    "residual_cos": "residual_cos",
    "origin_cos": "origin_cos",
    "delta_y": "delta_y",
    "delta_z": "delta_z",
    "yz_utilization": "yz_utilization",
}


def share(flag: Column) -> Column:
    """Mean of a boolean."""
    return F.avg(flag.cast("int"))


def file_audit(audit: DataFrame, group: Sequence[str] = FILE) -> DataFrame:
    """Pass rates, and mean and exact median of every measure, per (method, seed)."""
    rates = audit.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_samples"),
        share(F.col("yz_pass")).alias("yz_pass_rate"),
        share(F.col("x_pass")).alias("x_pass_rate"),
        share(F.col("joint_pass")).alias("joint_pass_rate"),
        share(~F.col("yz_pass")).alias("yz_fail_rate"),
        share(~F.col("x_pass")).alias("x_fail_rate"),
        *[F.avg(column).alias(f"{name}_mean") for name, column in MEASURES.items()],
    )
    long = audit.select(
        *group, *[F.col(column).alias(name) for name, column in MEASURES.items()]
    ).unpivot(list(group), list(MEASURES), "measure", "value")
    medians = (
        exact_quantiles(long, [*group, "measure"], "value", {"median": 0.5})
        .groupBy(*group)
        .pivot("measure", list(MEASURES))
        .agg(F.first("median"))
    )
    named = medians.select(*group, *[F.col(name).alias(f"{name}_median") for name in MEASURES])
    return rates.join(named, list(group))


def _coupling_cells() -> list[Column]:
    def cell(yz: bool, x: bool, name: str) -> Column:
        match = (F.col("yz_pass") == yz) & (F.col("x_pass") == x)
        return F.count(F.when(match, 1)).cast("double").alias(name)

    return [cell(True, True, "_a"), cell(True, False, "_b"), cell(False, True, "_c"), cell(False, False, "_d")]


def _coupling_columns() -> list[Column]:
    a, b, c, d = (F.col(n) for n in ("_a", "_b", "_c", "_d"))
    inside, outside = ratio(a, a + b), ratio(c, c + d)
    margin = F.sqrt((a + b) * (c + d) * (a + c) * (b + d))
    return [
        inside.alias("x_pass_within_yz_pass"),
        outside.alias("x_pass_within_yz_fail"),
        (inside - outside).alias("x_pass_difference"),
        ratio(a * d - b * c, margin).alias("phi"),
    ]


def coupling(audit: DataFrame, group: Sequence[str] = FILE) -> DataFrame:
    """How far passing one check depends on passing the other, with the phi coefficient."""
    return audit.groupBy(*group).agg(*_coupling_cells()).select(*group, *_coupling_columns())


def _severities() -> list[Column]:
    up = F.col("y_violate_high") + F.col("z_violate_high")
    down = F.col("y_violate_low") + F.col("z_violate_low")
    label = F.col("source_label")
    return [
        F.avg(F.when(label == 1, up)).alias("over_completion"),
        F.avg(F.when(label == 0, down)).alias("evidence_loss"),
    ]


def directional_failure(audit: DataFrame, group: Sequence[str] = FILE) -> DataFrame:
    """Upper-band severity of label 1 and lower-band severity of label 0."""
    return audit.groupBy(*group).agg(*_severities())


def method_summary(bridge: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and sample sd of each column over the seeds of a method."""
    parts = [F.count(F.lit(1)).alias("n_seeds")]
    for c in columns:
        parts += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd")]
    return bridge.groupBy("method").agg(*parts)


def joint_pass_by_label(audit: DataFrame) -> DataFrame:
    per_seed = audit.groupBy("method", "seed", "source_label").agg(
        share(F.col("joint_pass")).alias("rate")
    )
    return per_seed.groupBy("method", "source_label").agg(
        F.avg("rate").alias("mean"),
        F.stddev_samp("rate").alias("sd"),
        F.count(F.lit(1)).alias("n_seeds"),
    )


def bucket_mix(audit: DataFrame) -> DataFrame:
    """Count, mean residual, joint pass rate and percent share per method and bucket."""
    mix = audit.groupBy("method", "bucket_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("residual_cos").alias("residual_mean"),
        share(F.col("joint_pass")).alias("joint_pass_rate"),
    )
    total = F.sum("n").over(Window.partitionBy("method"))
    return mix.withColumn("percent", 100.0 * F.col("n") / total)


def contamination_summary(points: DataFrame, group: Sequence[str] = ("method", "source_label")) -> DataFrame:
    """Distribution of the opposite-label neighbour rate per method and label."""
    rate = F.col("opposite_rate")
    moments = points.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(rate).alias("mean"),
        F.stddev_samp(rate).alias("sd"),
        (100.0 * share(rate >= 0.5)).alias("percent_ge_50"),
        (100.0 * share(rate >= 0.8)).alias("percent_ge_80"),
    )
    medians = exact_quantiles(points, group, "opposite_rate", {"median": 0.5})
    return moments.join(medians, list(group)).withColumn(
        "direction", F.when(F.col("source_label") == 0, "0-to-1").otherwise("1-to-0")
    )


def residual_table(audit: DataFrame, group: Sequence[str] = ("method",)) -> DataFrame:
    """Count, mean, sd and five exact quantiles of the residual similarity."""
    moments = audit.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("residual_cos").alias("mean"),
        F.stddev_samp("residual_cos").alias("sd"),
    )
    cuts = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
    return moments.join(exact_quantiles(audit, group, "residual_cos", cuts), list(group))


def _residual_moments() -> list[Column]:
    return [
        F.avg("residual_cos").alias("residual_similarity_mean"),
        F.stddev_samp("residual_cos").alias("residual_similarity_sd"),
        F.count(F.lit(1)).alias("residual_similarity_n"),
    ]


def seed_residuals(audit: DataFrame) -> DataFrame:
    return audit.groupBy(*FILE).agg(*_residual_moments())


def _contamination_rates() -> list[Column]:
    rate, label = F.col("opposite_rate"), F.col("source_label")
    return [
        F.avg(rate).alias("overall_contamination"),
        F.avg(F.when(label == 1, rate)).alias("one_to_zero_contamination"),
        F.avg(F.when(label == 0, rate)).alias("zero_to_one_contamination"),
    ]


def bridge_table(points: DataFrame, utility: DataFrame) -> DataFrame:
    """One row per (method, seed): audit rates, coupling, severity, contamination, utility.

    ``points`` are audited candidates with their ``opposite_rate``; one pass over them
    feeds every column. ``utility(method, seed, f1)`` may miss seeds, whose F1 is NULL.
    """
    rates = [share(F.col(c)).alias(f"{c}_rate") for c in ("yz_pass", "x_pass", "joint_pass")]
    parts = [*rates, *_severities(), *_residual_moments(), *_contamination_rates()]
    cells = points.groupBy(*FILE).agg(*parts, *_coupling_cells())
    table = cells.select("*", *_coupling_columns()).drop("_a", "_b", "_c", "_d")
    return table.join(utility, list(FILE), "left")


def spearman(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Tie-averaged rank correlation of ``x`` and ``y`` per group, with its p-value.

    Equal pairs are counted first; rows with a NULL are dropped.
    """
    keys = list(group)
    known = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    counted = known.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w"))
    for axis in ("x", "y"):
        ranks = mid_ranks(known, keys, axis).select(
            *keys, axis, F.col("mid_rank").alias(f"_r{axis}")
        )
        counted = salted_join(counted, ranks, [*keys, axis])
    w, a, b = F.col("w"), F.col("_rx"), F.col("_ry")
    sums = counted.groupBy(*keys).agg(
        F.sum(w).alias("n"),
        F.sum(w * a).alias("_a"),
        F.sum(w * b).alias("_b"),
        F.sum(w * a * a).alias("_aa"),
        F.sum(w * b * b).alias("_bb"),
        F.sum(w * a * b).alias("_ab"),
    )
    n = F.col("n")
    covariance = F.col("_ab") - F.col("_a") * F.col("_b") / n
    spread_x = F.col("_aa") - F.col("_a") * F.col("_a") / n
    spread_y = F.col("_bb") - F.col("_b") * F.col("_b") / n
    rho = F.when((spread_x > 0) & (spread_y > 0), covariance / F.sqrt(spread_x * spread_y))
    t = F.when(
        n > 2,
        F.col("rho") * F.sqrt((n - 2) / F.nullif(F.greatest(1.0 - F.col("rho") * F.col("rho"), F.lit(0.0)), F.lit(0.0))),
    )
    return (
        sums.select(*keys, "n", rho.alias("rho"))
        .withColumn("_t", t)
        .withColumn("p_value", student_two_sided(F.col("_t"), (n - 2).cast("double")))
        .drop("_t")
    )


def named_pairs(table: DataFrame, pairs: Mapping[str, tuple[str, str]], *keep: str) -> DataFrame:
    """Long ``(pair, x, y)`` for named column pairs of a wide table."""
    cells = [
        F.struct(
            F.lit(name).alias("pair"),
            F.col(x).cast("double").alias("x"),
            F.col(y).cast("double").alias("y"),
        )
        for name, (x, y) in pairs.items()
    ]
    return table.select(*keep, F.inline(F.array(*cells)))


def regression_lines(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Least-squares line per group, where x takes at least two values."""
    known = pairs.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return (
        known.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope("y", "x").alias("slope"),
            F.regr_intercept("y", "x").alias("intercept"),
            F.min("x").alias("_lo"),
            F.max("x").alias("_hi"),
        )
        .where(F.col("_lo") < F.col("_hi"))
        .drop("_lo", "_hi")
    )


def standardized_deviation(bridge: DataFrame, metrics: Sequence[str], reference: str) -> DataFrame:
    """Per method and metric: mean over seeds and z-distance to the reference method.

    The z-score uses the population sd over the methods; a constant metric gives NULL.
    Methods are few, so the windows below see report-sized input.
    """
    means = bridge.groupBy("method").agg(*[F.avg(m).alias(m) for m in metrics])
    long = means.unpivot(["method"], list(metrics), "metric", "value")
    over = Window.partitionBy("metric")
    own = F.max(F.when(F.col("method") == reference, F.col("value"))).over(over)
    spread = F.stddev_pop("value").over(over)
    return long.select(
        "method",
        "metric",
        "value",
        own.alias("reference_value"),
        ((F.col("value") - own) / F.nullif(spread, F.lit(0.0))).alias("deviation"),
    )


def balance_distance(
    deviations: DataFrame, domains: Mapping[str, str], reference: str
) -> DataFrame:
    """RMS deviation overall and per domain, and the domain that departs most."""
    names = sorted(set(domains.values()))
    domain = F.coalesce(
        *[F.when(F.col("metric") == metric, F.lit(name)) for metric, name in domains.items()]
    )
    square = F.col("deviation") * F.col("deviation")
    tagged = deviations.withColumn("domain", domain)

    def rms(condition: Column | None = None) -> Column:
        return F.sqrt(F.avg(square if condition is None else F.when(condition, square)))

    table = tagged.groupBy("method").agg(
        rms().alias("overall_distance"),
        *[rms(F.col("domain") == name).alias(f"{name}_distance") for name in names],
    )
    # First of the sorted names wins a tie, as the largest (distance, -position) pair.
    ranked = F.array_max(
        F.array(
            *[
                F.struct(
                    F.col(f"{name}_distance").alias("d"),
                    F.lit(-i).alias("p"),
                    F.lit(name).alias("name"),
                )
                for i, name in enumerate(names)
            ]
        )
    )
    dominant = F.when(F.col("method") == reference, "reference").otherwise(ranked["name"])
    return table.withColumn("dominant_domain", dominant)


def matched_contrasts(
    summary: DataFrame,
    deviations: DataFrame,
    columns: Sequence[str],
    reference: str,
) -> DataFrame:
    """Raw and standardised deltas to the reference per column, and the largest departure."""
    own = summary.where(F.col("method") == reference).select(
        *[F.col(f"{c}_mean").alias(f"{c}_reference") for c in columns]
    )
    joined = summary.where(F.col("method") != reference).select(
        "method", F.lit(1).alias("_one"), *[F.col(f"{c}_mean") for c in columns]
    ).join(F.broadcast(own.withColumn("_one", F.lit(1))), "_one")
    deltas = joined.select(
        "method",
        *[(F.col(f"{c}_mean") - F.col(f"{c}_reference")).alias(f"delta_{c}") for c in columns],
    )
    wide = (
        deviations.where(F.col("metric").isin(*columns))
        .groupBy("method")
        .pivot("metric", list(columns))
        .agg(F.first("deviation"))
        .select("method", *[F.col(c).alias(f"standardized_{c}") for c in columns])
    )
    size = F.struct(F.abs("deviation"), F.col("metric"))
    dominant = deviations.where(F.col("deviation").isNotNull()).groupBy("method").agg(
        F.max_by("metric", size).alias("dominant_metric"),
        F.max_by("deviation", size).alias("dominant_deviation"),
    )
    return deltas.join(wide, "method", "left").join(dominant, "method", "left")
