"""Data contracts. Each check returns a DataFrame of violations; none is a pass.

``require`` turns violations into an error. Checks aggregate before they compare, so
their shuffles carry keys and counts rather than rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import role_name, strip
from pairforge.operators.pairs import pair_margin

# Fixed role names of the evaluation firewall.
ALLOWED_ROLES = ("cv_validation", "adress_validation")
FORBIDDEN_ROLES = (
    "lu",
    "lu_external",
    "pitt",
    "pitt_external",
    "external",
    "external_evaluation",
)
TRAINING_MODES = ("source_plus_augmentation", "full_training_table")
SHUFFLE_SOURCES = ("generation_seed", "classifier_seed")


def require(violations: DataFrame, message: str) -> None:
    """Raise when a check found anything; shows at most a few rows."""
    found = violations.take(5)
    if found:
        raise ValueError(f"{message}: {[row.asDict() for row in found]}")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Counts and the largest margin recomputation error, in one row."""
    per_source = pairs.groupBy("train_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(pair_margin("chosen_", "rejected_") - F.col("pair_margin"))).alias("error"),
        F.count(F.when(F.col("pair_margin") < 1.0, 1)).alias("low"),
        F.count(F.when(~F.col("pair_mode").eqNullSafe("aligned"), 1)).alias("mode"),
    )
    return per_source.agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("n").alias("pairs"),
        F.min("n").alias("minimum_pairs_per_source"),
        F.max("n").alias("maximum_pairs_per_source"),
        F.max("error").alias("maximum_margin_error"),
        F.sum("low").alias("low_margin_pairs"),
        F.sum("mode").alias("unaligned_pairs"),
    )


def validate_pairs(
    pairs: DataFrame,
    *,
    sources: int | None = None,
    count: int | None = None,
    minimum: int | None = None,
    maximum: int | None = None,
    tolerance: float = 1e-10,
) -> DataFrame:
    """Violations of the pair table as ``(check)`` rows."""
    rules: list[tuple[str, Column]] = [
        ("margin_mismatch", F.col("maximum_margin_error") > tolerance),
        ("low_margin", F.col("low_margin_pairs") > 0),
        ("unaligned", F.col("unaligned_pairs") > 0),
    ]
    bounds = (
        ("source_count", sources, F.col("sources") != F.lit(sources)),
        ("pair_count", count, F.col("pairs") != F.lit(count)),
        ("too_few_pairs", minimum, F.col("minimum_pairs_per_source") < F.lit(minimum)),
        ("too_many_pairs", maximum, F.col("maximum_pairs_per_source") > F.lit(maximum)),
    )
    rules += [(name, rule) for name, limit, rule in bounds if limit is not None]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return pair_summary(pairs).select(F.explode(found).alias("check"))


def grid_gaps(df: DataFrame, group: Sequence[str], rows: str, columns: str) -> DataFrame:
    """Cells of the full (rows x columns) grid that no record covers, per group.

    The column axis of a group is collected once (an axis of seeds, not of data) and
    each row value lacks what its own set does not hold.
    """
    cells = df.select(*group, rows, columns).distinct()
    axis = cells.groupBy(*group).agg(F.collect_set(columns).alias("_axis"))
    seen = cells.groupBy(*group, rows).agg(F.collect_set(columns).alias("_seen"))
    return seen.join(axis, list(group)).select(
        *group, rows, F.explode(F.array_except("_axis", "_seen")).alias(columns)
    )


def grid_shape(df: DataFrame, group: Sequence[str], rows: str, columns: str) -> DataFrame:
    """Row count and distinct values on both axes per group."""
    cells = df.groupBy(*group, rows, columns).agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy(*group).agg(
        F.sum("_n").alias("n_rows"),
        F.countDistinct(rows).alias(f"n_{rows}"),
        F.countDistinct(columns).alias(f"n_{columns}"),
    )


def validate_run_manifest(
    manifest: DataFrame, generation_seeds: int = 5, classifier_seeds: int = 5
) -> DataFrame:
    """Violations of one predefined run grid as ``(check, subject)`` rows."""
    spark_rows = manifest.withColumn("_all", F.lit(1))
    mode = F.lower(strip(F.coalesce("training_mode", F.lit(TRAINING_MODES[0]))))
    shuffle = F.lower(strip(F.coalesce("shuffle_seed_source", F.lit(SHUFFLE_SOURCES[0]))))
    shape = grid_shape(spark_rows, ["_all"], "generation_seed", "classifier_seed")
    wanted = {
        "n_rows": generation_seeds * classifier_seeds,
        "n_generation_seed": generation_seeds,
        "n_classifier_seed": classifier_seeds,
    }
    wrong = F.array_compact(
        F.array(*[F.when(F.col(c) != n, F.lit(c)) for c, n in wanted.items()])
    )
    gaps = grid_gaps(spark_rows, ["_all"], "generation_seed", "classifier_seed")
    parts = [
        shape.select(F.lit("grid_shape").alias("check"), F.explode(wrong).alias("subject")),
        gaps.select(
            F.lit("missing_run").alias("check"),
            F.concat_ws(":", "generation_seed", "classifier_seed").alias("subject"),
        ),
        duplicate_keys(manifest, ["checkpoint_output"]).select(
            F.lit("shared_output").alias("check"), F.col("checkpoint_output").alias("subject")
        ),
    ]
    for check, value, allowed in (
        ("role", role_name(F.col("validation_role")), ALLOWED_ROLES),
        ("training_mode", mode, TRAINING_MODES),
        ("shuffle_source", shuffle, SHUFFLE_SOURCES),
    ):
        bad = manifest.select(F.coalesce(value, F.lit("")).alias("subject")).where(~F.col("subject").isin(*allowed))
        parts.append(bad.distinct().select(F.lit(check).alias("check"), "subject"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def firewall(rows: DataFrame, declared: str, column: str = "dataset_role") -> DataFrame:
    """Roles that must not take part in selection: forbidden or other than declared.

    A missing role counts as the empty one, which is unsupported.
    """
    role = F.col("role")
    kind = (
        F.when(role.isin(*FORBIDDEN_ROLES), "external")
        .when(~role.isin(*ALLOWED_ROLES), "unsupported")
        .when(role != declared, "undeclared")
    )
    counted = rows.groupBy(F.coalesce(role_name(F.col(column)), F.lit("")).alias("role")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.withColumn("violation", kind).where(F.col("violation").isNotNull())


def manifest_keys(manifest: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Empty required fields and repeated keys of a manifest, counted per key."""
    empty = [
        F.count(F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", 1)).alias(f"empty_{c}")
        for c in required
    ]
    counted = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *empty)
    bad = (F.col("n") > 1) | (F.coalesce(strip(F.col(key)), F.lit("")) == "")
    for c in required:
        bad = bad | (F.col(f"empty_{c}") > 0)
    return counted.where(bad)


def prediction_gaps(predictions: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """Units that a (method, weight) of their dataset does not cover completely.

    Weights per dataset are few; a unit carries only the set it has seen.
    """
    complete = predictions
    for c in values:
        complete = complete.where(F.col(c).isNotNull())
    weight = F.struct("method", "weight_id").alias("w")
    axis = (
        predictions.select("dataset", weight).distinct().groupBy("dataset").agg(
            F.collect_set("w").alias("_axis")
        )
    )
    units = predictions.select("dataset", "unit").distinct()
    seen = complete.select("dataset", "unit", weight).distinct().groupBy("dataset", "unit").agg(
        F.collect_set("w").alias("_seen")
    )
    empty = F.array().cast("array<struct<method:string,weight_id:string>>")
    rows = units.join(seen, ["dataset", "unit"], "left").join(axis, "dataset")
    gap = F.array_except("_axis", F.coalesce("_seen", empty))
    return rows.select("dataset", "unit", F.explode(gap).alias("w")).select(
        "dataset", "unit", "w.method", "w.weight_id"
    )


def outcome_conflicts(predictions: DataFrame) -> DataFrame:
    """Units whose outcome differs between the weights of a method."""
    return (
        predictions.groupBy("method", "dataset", "unit")
        .agg(F.min("y_true").alias("lowest"), F.max("y_true").alias("highest"))
        .where(F.col("lowest") != F.col("highest"))
    )


def audit_keys(
    audit: DataFrame,
    keys: Sequence[str],
    metric: str = "residual_cos",
    expected: Mapping[str, int] | None = None,
) -> DataFrame:
    """``(check, method, n)``: null keys, repeated keys, foreign rows, null metric, counts."""
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    own = F.col("source_id").cast("string").eqNullSafe(F.col("source_row_index").cast("string"))
    per_method = audit.groupBy("method").agg(
        F.count(F.when(null_key, 1)).alias("null_key"),
        F.count(F.when(~own, 1)).alias("foreign_source"),
        F.count(F.when(F.col(metric).isNull(), 1)).alias("null_metric"),
        F.count(F.lit(1)).alias("rows"),
    )
    flat = per_method.unpivot(
        ["method"], ["null_key", "foreign_source", "null_metric"], "check", "n"
    ).where(F.col("n") > 0)
    repeated = duplicate_keys(audit, keys).groupBy("method").agg(F.sum("n").alias("n"))
    result = flat.unionByName(repeated.withColumn("check", F.lit("repeated_key")))
    if expected is not None:
        wanted = F.coalesce(
            *[F.when(F.col("method") == m, F.lit(n)) for m, n in expected.items()], F.lit(-1)
        )
        off = per_method.where(F.col("rows") != wanted)
        result = result.unionByName(
            off.select("method", F.lit("row_count").alias("check"), F.col("rows").alias("n"))
        )
    return result


def count_contract(df: DataFrame, keys: Sequence[str], column: str, expected: int) -> DataFrame:
    """Rows whose recorded count is not the expected one."""
    return df.where(~F.col(column).eqNullSafe(F.lit(expected))).select(*keys, column)


def unmatched_groups(df: DataFrame, first: str, second: str, keys: Sequence[str]) -> DataFrame:
    """Keys present in one of two cohorts only."""
    sides = df.where(F.col("dataset").isin(first, second)).groupBy(*keys).agg(
        F.max((F.col("dataset") == first).cast("int")).alias("_a"),
        F.max((F.col("dataset") == second).cast("int")).alias("_b"),
    )
    return sides.where(F.col("_a") + F.col("_b") == 1).select(
        *keys, F.when(F.col("_a") == 1, first).otherwise(second).alias("only_in")
    )


def average_check(
    summary: DataFrame, first: str, second: str, average: str, tolerance: float = 1e-12
) -> DataFrame:
    """Every external average against the mean of its two cohorts."""

    def value(dataset: str) -> Column:
        return F.max(F.when(F.col("dataset") == dataset, F.col("mean")))

    table = summary.groupBy("method", "metric").agg(
        ((value(first) + value(second)) / 2.0).alias("expected"), value(average).alias("observed")
    )
    return table.withColumn("abs_diff", F.abs(F.col("expected") - F.col("observed"))).withColumn(
        "pass", F.col("abs_diff") < tolerance
    )


def metric_grid(intervals: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Number of bootstrapped metrics per method and dataset, and whether all are there."""
    return (
        intervals.groupBy("method", "dataset")
        .agg(F.countDistinct("metric").alias("n_metrics"))
        .withColumn("complete", F.col("n_metrics") == len(metrics))
    )


def missing_methods(df: DataFrame, required: Sequence[str], column: str = "method") -> DataFrame:
    wanted = df.sparkSession.createDataFrame([(m,) for m in required], f"{column} string")
    return wanted.join(df.select(column).distinct(), column, "left_anti")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a parent, counted before the join."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(parents.select(key).distinct(), key, "left_anti")


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], validate: str, how: str = "inner"
) -> DataFrame:
    """Equi-join that first checks ``one_to_one``, ``many_to_one`` or ``one_to_many``."""
    if validate in ("one_to_one", "one_to_many"):
        require(duplicate_keys(left, on), "left join keys repeat")
    if validate in ("one_to_one", "many_to_one"):
        require(duplicate_keys(right, on), "right join keys repeat")
    return left.join(right, list(on), how)


def complete_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], probe: str) -> DataFrame:
    """Left join in which every row must find a match carrying ``probe``."""
    require(
        left.select(*on).distinct().join(
            right.where(F.col(probe).isNotNull()).select(*on).distinct(), list(on), "left_anti"
        ),
        "rows without a match",
    )
    return left.join(right, list(on), "left")
