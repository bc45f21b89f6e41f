"""Checkpoint selection from metric tables, and early-stop replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.text import role_name, strip
from pairforge.operators.contracts import ALLOWED_ROLES, firewall, require


def normalized_metrics(rows: DataFrame) -> DataFrame:
    return rows.select(
        strip(F.col("checkpoint")).alias("checkpoint"),
        F.col("epoch").cast("int").alias("epoch"),
        role_name(F.col("dataset_role")).alias("dataset_role"),
        F.lower(strip(F.col("metric_name"))).alias("metric_name"),
        F.col("metric_value").cast("double").alias("metric_value"),
        *[c for c in ("ordinal",) if c in rows.columns],
    )


def wide_metrics(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per (checkpoint, epoch). A repeated metric keeps its last value when the
    rows carry an ``ordinal``; without one, the largest."""
    last = F.col("ordinal") if "ordinal" in rows.columns else F.col("metric_value")
    return rows.groupBy("checkpoint", "epoch").agg(
        *[
            F.max_by(
                F.when(F.col("metric_name") == m, F.col("metric_value")),
                F.when(F.col("metric_name") == m, last),
            ).alias(m)
            for m in metrics
        ]
    )


def select_checkpoint(
    rows: DataFrame,
    role: str,
    primary: str,
    secondary: str | None = None,
    check: bool = True,
) -> DataFrame:
    """Best checkpoint: primary, then secondary, then earliest epoch, then largest name.

    Any row of a forbidden, undeclared or missing role fails the whole selection. The role
    and metric arguments may be written in any case.
    """
    role, primary = role.strip().lower(), primary.strip().lower()
    secondary = secondary.strip().lower() if secondary else None
    metrics = normalized_metrics(rows)
    if check:
        if role not in ALLOWED_ROLES:
            raise ValueError(f"unsupported validation role {role!r}")
        require(firewall(metrics, role), "selection input holds other roles")
    names = [primary] + ([secondary] if secondary else [])
    wide = wide_metrics(metrics, names)
    for name in names:
        wide = wide.where(F.col(name).isNotNull())
    order = F.struct(*[F.col(n) for n in names], -F.col("epoch"), F.col("checkpoint"))
    best = F.max_by(F.struct(*wide.columns), order)
    return wide.agg(best.alias("best")).where(F.col("best").isNotNull()).select("best.*")


def selection_record(
    rows: DataFrame, role: str, primary: str, secondary: str | None, digest: str
) -> DataFrame:
    """The selected checkpoint with its rule and the digest of the input file."""
    rule = "secondary metric, then earliest epoch" if secondary else "earliest epoch"
    best = select_checkpoint(rows, role, primary, secondary)
    return best.select(
        "checkpoint",
        "epoch",
        F.lit(role).alias("validation_role"),
        F.lit(primary).alias("primary_metric"),
        F.col(primary).alias("primary_value"),
        F.lit(secondary).cast("string").alias("secondary_metric"),
        (F.col(secondary) if secondary else F.lit(None).cast("double")).alias("secondary_value"),
        F.lit(rule).alias("tie_breaker"),
        F.lit(digest).alias("metrics_sha256"),
    )


def early_stop(history: DataFrame, patience: int, use_f1: bool = True) -> DataFrame:
    """Best epoch and epochs run per checkpoint, replayed over ``(epoch, accuracy, f1)``.

    An epoch improves when accuracy rises, or (with ``use_f1``) stays equal while F1
    rises. Training stops after ``patience`` epochs in a row without improvement. A run
    has as many rows as epochs.
    """
    score = F.struct("accuracy", "f1") if use_f1 else F.struct("accuracy")
    by_epoch = Window.partitionBy("checkpoint").orderBy("epoch")
    before = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    sofar = by_epoch.rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        history.withColumn("_score", score)
        .withColumn("_best", F.max("_score").over(before))
        .withColumn("_improved", F.col("_best").isNull() | (F.col("_score") > F.col("_best")))
        .withColumn("_step", F.row_number().over(by_epoch))
        .withColumn("_last", F.max(F.when(F.col("_improved"), F.col("_step"))).over(sofar))
        .withColumn("_idle", F.col("_step") - F.col("_last"))
        # Rows after the first stop were never run.
        .withColumn("_stopped", F.max((F.col("_idle") >= patience).cast("int")).over(before))
        .where(F.coalesce("_stopped", F.lit(0)) == 0)
    )
    return marked.groupBy("checkpoint").agg(
        F.max(F.when(F.col("_improved"), F.col("epoch"))).alias("best_epoch"),
        F.count(F.lit(1)).alias("epochs_run"),
        F.max("accuracy").alias("best_accuracy"),
    )
