"""Classification, calibration and ranking metrics per trained weight, and roll-ups.

Prediction rows hold ``method, dataset, weight_id, unit, y_true, y_pred, y_prob`` and
the seeds. Undefined metrics are NULL, never NaN, because ``avg`` skips NULL only.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pairforge.functions.numeric import ratio
from pairforge.operators.scaling import durable, running_totals, slice_count, top_k, written

WEIGHT = ("method", "dataset", "weight_id")
CONFUSION_METRICS = (
    "accuracy",
    "balanced_accuracy",
    "precision",
    "sensitivity",
    "specificity",
    "f1",
)
METRICS = (*CONFUSION_METRICS, "auroc", "auprc", "brier", "ece")
AVERAGE = "external_average"
KEPT_ROWS = 500_000  # predictions that a task of ``keep_first`` holds, about


def keep_first(predictions: DataFrame, order: str = "row_idx") -> DataFrame:
    """The first row by ``order`` of every weight and unit; later ones are repeats.

    ``order`` is unique within a weight and unit, and is dropped. Columns of numbers are
    picked by a hash aggregation, others need a sort. Several steps read the result, so it is cut.
    The rows are dealt to tasks by number, since their shuffled bytes are a poor measure of
    what a task holds. A unit's rows stay together, which compresses them well.
    """
    keys = [*WEIGHT, "unit"]
    cores = predictions.sparkSession.sparkContext.defaultParallelism
    predictions = predictions.repartition(max(cores, ceil(predictions.count() / KEPT_ROWS)), "unit")
    rest = {f.name: f.dataType for f in predictions.schema if f.name not in (*keys, order)}
    if all(isinstance(t, NumericType) for t in rest.values()):
        return written(predictions.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest]))
    return written(top_k(predictions, keys, [F.col(order)], 1, "_first").drop("_first", order))


def agreeing_weights(predictions: DataFrame) -> DataFrame:
    """One row per weight with the digests of its units and of their outcomes.

    Reading it fails where the weights of a method and dataset differ in their units, lack a
    prediction, or differ in an outcome. Digests are 64-bit sums modulo 2, so repeated units
    must be gone.
    """
    lacking = F.col("unit").isNull() | F.col("y_true").isNull() | F.col("y_pred").isNull() | F.col("y_prob").isNull()
    weights = predictions.groupBy(*WEIGHT).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(lacking).alias("lacking"),
        F.bit_xor(F.xxhash64("unit")).alias("units"),
        F.bit_xor(F.xxhash64("unit", "y_true")).alias("outcomes"),
    )
    same = Window.partitionBy("method", "dataset")

    def differs(column: str) -> Column:
        return F.min(column).over(same) != F.max(column).over(same)

    def fail(message: str) -> Column:
        return F.raise_error(F.concat_ws(", ", F.lit(message), "method", "dataset")).cast("boolean")

    marked = weights.withColumn("_gap", differs("n") | differs("units") | (F.col("lacking") > 0)).withColumn(
        "_conflict", differs("outcomes")
    )
    sound = F.when(F.col("_gap"), fail("incomplete prediction grid")).when(
        F.col("_conflict"), fail("outcomes differ between weights")
    )
    return marked.where(sound.isNull()).drop("_gap", "_conflict", "lacking")


def confusion_counts(weight: Column | None = None) -> list[Column]:
    """Aggregates ``tp, tn, fp, fn``, optionally weighted."""
    one = F.lit(1) if weight is None else weight
    y, p = F.col("y_true"), F.col("y_pred")

    def cell(truth: int, predicted: int, name: str) -> Column:
        return F.sum(F.when((y == truth) & (p == predicted), one).otherwise(0)).cast(
            "double"
        ).alias(name)

    return [cell(1, 1, "tp"), cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn")]


def confusion_metrics(df: DataFrame) -> DataFrame:
    """Metrics from the four counts; zero denominators give NULL."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return (
        df.withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
        .withColumn("sensitivity", ratio(tp, tp + fn))
        .withColumn("specificity", ratio(tn, tn + fp))
        .withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2.0)
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("f1", ratio(2.0 * tp, 2.0 * tp + fp + fn))
        .drop("tp", "tn", "fp", "fn")
    )


def weight_metrics(predictions: DataFrame, group: Sequence[str] = WEIGHT) -> DataFrame:
    """Confusion metrics and Brier score per weight."""
    brier = F.avg(F.pow(F.col("y_prob") - F.col("y_true"), 2)).alias("brier")
    return confusion_metrics(predictions.groupBy(*group).agg(*confusion_counts(), brier))


def zero_filled(metrics: DataFrame) -> DataFrame:
    """Checkpoint-history variant: accuracy, precision, recall, F1 with 0 for undefined."""
    return metrics.select(
        *[c for c in WEIGHT if c in metrics.columns],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("accuracy", "precision")],
        F.coalesce("sensitivity", F.lit(0.0)).alias("recall"),
        F.coalesce("f1", F.lit(0.0)).alias("f1"),
    )


def order_statistics(predictions: DataFrame, group: Sequence[str] = WEIGHT) -> DataFrame:
    """Rows with their place by (probability, unit): the one sort behind all rank metrics."""
    rows = predictions.select(*group, "unit", "y_true", "y_prob")
    return running_totals(
        rows, group, ["y_prob", "unit"], {"n": F.lit(1), "pos": F.col("y_true")}, slice_count(predictions)
    )


def _rank_sums() -> list[Column]:
    positive = F.col("y_true") == 1
    precision_here = (F.col("pos_all") - F.col("pos_before")) / (F.col("n_all") - F.col("n_before"))
    return [
        F.sum(F.when(positive, F.col("n_before") + 1)).cast("double").alias("_rank_sum"),
        F.sum(F.when(positive, precision_here)).alias("_precision_sum"),
        F.max("pos_all").cast("double").alias("_pos"),
        F.max("n_all").cast("double").alias("_n"),
    ]


def _from_rank_sums() -> list[Column]:
    pos, n = F.col("_pos"), F.col("_n")
    return [
        ratio(F.col("_rank_sum") - pos * (pos + 1) / 2.0, pos * (n - pos)).alias("auroc"),
        ratio(F.col("_precision_sum"), pos).alias("auprc"),
    ]


def ranking_metrics(placed: DataFrame, group: Sequence[str] = WEIGHT) -> DataFrame:
    """AUROC from ordinal ranks and average precision in the reversed order."""
    return placed.groupBy(*group).agg(*_rank_sums()).select(*group, *_from_rank_sums())


def auroc_mid_ranks(predictions: DataFrame, group: Sequence[str] = WEIGHT) -> DataFrame:
    """AUROC with tied probabilities sharing their mean rank."""
    counted = predictions.groupBy(*group, "y_prob").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("pos")
    )
    placed = running_totals(counted, group, ["y_prob"], {"n": F.col("n"), "pos": F.col("pos")})
    mid = F.col("n_before") + (F.col("n") + 1) / 2.0
    sums = placed.groupBy(*group).agg(
        F.sum(F.col("pos") * mid).alias("_rank_sum"),
        F.max("pos_all").cast("double").alias("_pos"),
        F.max("n_all").cast("double").alias("_n"),
    )
    pos, n = F.col("_pos"), F.col("_n")
    return sums.select(
        *group, ratio(F.col("_rank_sum") - pos * (pos + 1) / 2.0, pos * (n - pos)).alias("auroc")
    )


def _bin(bins: int) -> Column:
    """Equal-frequency bin of a placed row; the first bins take the rest."""
    k = F.least(F.lit(bins), F.col("n_all"))
    size = F.floor(F.col("n_all") / k)
    larger = F.col("n_all") % k
    i = F.col("n_before")
    in_larger = larger * (size + 1)
    return F.when(i < in_larger, F.floor(i / (size + 1))).otherwise(
        larger + F.floor((i - in_larger) / size)
    )


def calibration_error(
    placed: DataFrame, bins: int = 10, group: Sequence[str] = WEIGHT
) -> DataFrame:
    """Expected calibration error over equal-frequency bins."""
    per_bin = placed.groupBy(*group, _bin(bins).alias("_bin")).agg(*_bin_sums())
    return per_bin.groupBy(*group).agg(_from_bin_sums())


def _bin_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("_rows"),
        F.max("n_all").alias("_all"),
        F.abs(F.avg("y_true") - F.avg("y_prob")).alias("_gap"),
    ]


def _from_bin_sums() -> Column:
    return F.sum(F.col("_rows") / F.col("_all") * F.col("_gap")).alias("ece")


def placed_metrics(placed: DataFrame, bins: int = 10, group: Sequence[str] = WEIGHT) -> DataFrame:
    """``ranking_metrics`` and ``calibration_error`` from one reading of the placed rows."""
    per_bin = placed.groupBy(*group, _bin(bins).alias("_bin")).agg(*_rank_sums(), *_bin_sums())
    sums = [F.sum(c).alias(c) for c in ("_rank_sum", "_precision_sum")]
    whole = [F.max(c).alias(c) for c in ("_pos", "_n")]
    return per_bin.groupBy(*group).agg(*sums, *whole, _from_bin_sums()).select(*group, *_from_rank_sums(), "ece")


def all_metrics(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """All ten metrics per weight, one row each."""
    placed = order_statistics(predictions)
    return (
        weight_metrics(predictions)
        .join(placed_metrics(placed, bins), list(WEIGHT))
        .select(*WEIGHT, *METRICS)
    )


def seed_groups(predictions: DataFrame) -> DataFrame:
    """Top-level seed of every weight, decided per method and dataset.

    Generation seed when the method has any, else training seed, else the weight.
    """
    weights = predictions.groupBy(*WEIGHT).agg(
        F.max("aug_seed").alias("aug_seed"), F.max("train_seed").alias("train_seed")
    )
    any_generated = F.max(F.col("aug_seed").isNotNull()).over(
        Window.partitionBy("method", "dataset")
    )
    return weights.withColumn("_generated", any_generated).select(
        *WEIGHT,
        F.when(F.col("_generated"), F.concat(F.lit("aug_seed_"), F.col("aug_seed").cast("int")))
        .when(
            F.col("train_seed").isNotNull(),
            F.concat(F.lit("train_seed_"), F.col("train_seed").cast("int")),
        )
        .otherwise(F.concat(F.lit("weight_"), "weight_id"))
        .alias("seed_group"),
        F.when(F.col("_generated"), "generation_seed")
        .otherwise("classifier_seed")
        .alias("group_basis"),
    )


def seed_level(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Average the weights inside each seed group: a small table, read several times."""
    return durable(
        metrics.join(groups, list(WEIGHT))
        .groupBy("method", "dataset", "seed_group", "group_basis")
        .agg(*[F.avg(m).alias(m) for m in METRICS if m in metrics.columns])
    )


def external_average(detail: DataFrame, first: str, second: str) -> DataFrame:
    """Unweighted mean of two cohorts per seed group, as rows of a new dataset."""
    keys = ["method", "seed_group", "group_basis"]
    names = [m for m in METRICS if m in detail.columns]

    def cohort(dataset: str, suffix: str) -> DataFrame:
        return detail.where(F.col("dataset") == dataset).select(
            *keys, *[F.col(m).alias(m + suffix) for m in names]
        )

    sides = (
        cohort(first, "_a").withColumn("_in_a", F.lit(True)),
        cohort(second, "_b").withColumn("_in_b", F.lit(True)),
    )
    one_sided = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    missing = F.raise_error(F.concat(F.lit("a seed group is in one cohort only: "), "method"))
    # In a filter, which no choice of columns takes out.
    sound = F.when(one_sided, missing.cast("boolean")).otherwise(F.lit(True))
    return sides[0].join(sides[1], keys, "full").where(sound).select(
        "method",
        F.lit(AVERAGE).alias("dataset"),
        "seed_group",
        "group_basis",
        *[((F.col(m + "_a") + F.col(m + "_b")) / 2.0).alias(m) for m in names],
    )


def summarize_seeds(detail: DataFrame) -> DataFrame:
    """Mean, sample standard deviation and count over seed groups, in long form."""
    names = [m for m in METRICS if m in detail.columns]
    long = detail.unpivot(
        ["method", "dataset", "seed_group", "group_basis"], names, "metric", "value"
    )
    return long.groupBy("method", "dataset", "group_basis", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.count("value").alias("n_groups"),
    )


def family_lock(predictions: DataFrame) -> DataFrame:
    """First (family, group) of every method in sort order."""
    first = F.min(F.struct("family", "method_group"))
    return (
        predictions.groupBy("method").agg(first.alias("f")).select("method", "f.family", "f.method_group")
    )
