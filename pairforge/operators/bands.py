"""Class statistics, label-directional bands and candidate evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.operators.scaling import exact_quantiles, pick_quantiles, placed_values
from pairforge.settings import ScoringSettings

BAND_FLOOR = 1e-8
SCALE_FLOOR = 1e-6


def scaled_mad(
    df: DataFrame, group: Sequence[str], value: str, factor: float = 1.4826
) -> DataFrame:
    """Median and scaled median absolute deviation per group, floored."""
    placed = placed_values(df, group, value)
    medians = pick_quantiles(placed, group, {"center": 0.5})
    spread = placed.join(medians, list(group)).select(
        *group, F.abs(F.col("_value") - F.col("center")).alias("_dev"), "_n"
    )
    mads = exact_quantiles(spread, group, "_dev", {"_mad": 0.5}, weight="_n")
    return medians.join(mads, list(group)).select(
        *group,
        "center",
        F.greatest(F.lit(factor) * F.col("_mad"), F.lit(SCALE_FLOOR)).alias("scale"),
    )


def class_statistics(
    sources: DataFrame, settings: ScoringSettings = ScoringSettings()
) -> DataFrame:
    """Per label: centre, scale, 10 % and 90 % quantiles of breadth and depth.

    Both measures share every pass; equal values collapse before each shuffle.
    """
    binary = sources.where(F.col("label").isin(0, 1))
    measures = binary.select("label", "breadth", "depth").unpivot(
        ["label"], ["breadth", "depth"], "measure", "x"
    )
    keys = ["label", "measure"]
    placed = placed_values(measures, keys, "x")
    quantiles = pick_quantiles(placed, keys, {"center": 0.5, "low": 0.1, "high": 0.9})
    # Two labels times two measures: four rows.
    spread = placed.join(F.broadcast(quantiles), keys).select(
        *keys, F.abs(F.col("_value") - F.col("center")).alias("dev"), "_n"
    )
    mads = exact_quantiles(spread, keys, "dev", {"mad": 0.5}, weight="_n")
    long = quantiles.join(mads, keys).withColumn(
        "scale", F.greatest(F.lit(settings.mad_factor) * F.col("mad"), F.lit(SCALE_FLOOR))
    )

    def pick(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    names = {"center": "center", "scale": "scale", "low": "lower_risk", "high": "upper_risk"}
    return long.groupBy("label").agg(
        *[
            pick(measure, column).alias(f"{prefix}_{name}")
            for prefix, measure in (("y", "breadth"), ("z", "depth"))
            for column, name in names.items()
        ]
    )


def with_bands(
    sources: DataFrame, statistics: DataFrame, settings: ScoringSettings = ScoringSettings()
) -> DataFrame:
    """Attach the source-centred bands. ``statistics`` has one row per binary label."""
    rising, falling = settings.risk_multiplier, settings.safe_multiplier
    positive = F.col("label") == 1
    up = F.when(positive, F.lit(rising)).otherwise(F.lit(falling))
    down = F.when(positive, F.lit(falling)).otherwise(F.lit(rising))
    two_rows = statistics.where(F.col("label").isin(0, 1)).select("label", "y_scale", "z_scale")
    return (
        sources.join(F.broadcast(two_rows), "label")
        .withColumn("eps_y_plus", up * F.col("y_scale"))
        .withColumn("eps_y_minus", down * F.col("y_scale"))
        .withColumn("eps_z_plus", up * F.col("z_scale"))
        .withColumn("eps_z_minus", down * F.col("z_scale"))
        .withColumn("y_lower", F.col("breadth") - F.col("eps_y_minus"))
        .withColumn("y_upper", F.col("breadth") + F.col("eps_y_plus"))
        .withColumn("z_lower", F.col("depth") - F.col("eps_z_minus"))
        .withColumn("z_upper", F.col("depth") + F.col("eps_z_plus"))
        .drop("y_scale", "z_scale")
    )


def utilization(delta: Column, plus: Column, minus: Column) -> Column:
    band = F.when(delta >= 0, plus).otherwise(minus)
    return F.least(F.abs(delta) / F.greatest(band, F.lit(BAND_FLOOR)), F.lit(1.0))


def excess_low(delta: Column, minus: Column) -> Column:
    band = F.greatest(minus, F.lit(BAND_FLOOR))
    return F.greatest(F.lit(0.0), (-delta - band) / band)


def excess_high(delta: Column, plus: Column) -> Column:
    band = F.greatest(plus, F.lit(BAND_FLOOR))
    return F.greatest(F.lit(0.0), (delta - band) / band)


def check_bands(df: DataFrame) -> DataFrame:
    """Deltas, violations and utilisation of candidates against their source's bands.

    Needs ``candidate_y, candidate_z, breadth, depth`` and the four ``eps_*`` columns.
    """
    df = df.withColumn("delta_y", F.col("candidate_y") - F.col("breadth")).withColumn(
        "delta_z", F.col("candidate_z") - F.col("depth")
    )
    for axis in ("y", "z"):
        delta = F.col(f"delta_{axis}")
        plus, minus = F.col(f"eps_{axis}_plus"), F.col(f"eps_{axis}_minus")
        df = (
            df.withColumn(f"{axis}_util", utilization(delta, plus, minus))
            .withColumn(f"{axis}_violate_low", excess_low(delta, minus))
            .withColumn(f"{axis}_violate_high", excess_high(delta, plus))
        )
    violation = (
        F.col("y_violate_low")
        + F.col("y_violate_high")
        + F.col("z_violate_low")
        + F.col("z_violate_high")
    )
    return (
        df.withColumn("yz_violation_score", violation)
        .withColumn("yz_pass", F.col("yz_violation_score") == 0.0)
        .withColumn("yz_utilization", F.lit(0.5) * (F.col("y_util") + F.col("z_util")))
    )


def residual_limit(label: Column, settings: ScoringSettings = ScoringSettings()) -> Column:
    return F.when(label == 1, F.lit(settings.residual_limit_positive)).when(
        label == 0, F.lit(settings.residual_limit_negative)
    )


def evaluate_candidates(
    df: DataFrame, settings: ScoringSettings = ScoringSettings()
) -> DataFrame:
    """Band check, residual check and the four-way bucket."""
    limit = F.col("cosine_threshold")
    both, band, residual = "yz_pass_x_pass", "yz_pass_x_fail", "yz_fail_x_pass"
    return (
        check_bands(df)
        .withColumn("cosine_threshold", residual_limit(F.col("label"), settings))
        .withColumn("x_pass", F.col("residual_cos") < limit)
        .withColumn(
            "x_violation_score",
            F.greatest(
                F.lit(0.0),
                (F.col("residual_cos") - limit) / F.greatest(limit, F.lit(BAND_FLOOR)),
            ),
        )
        .withColumn(
            "bucket_id",
            F.when(F.col("yz_pass") & F.col("x_pass"), 0)
            .when(F.col("yz_pass"), 1)
            .when(F.col("x_pass"), 2)
            .otherwise(3),
        )
        .withColumn(
            "bucket_name",
            F.element_at(
                F.array(*[F.lit(n) for n in (both, band, residual, "yz_fail_x_fail")]),
                F.col("bucket_id") + 1,
            ),
        )
    )
