"""From predictions to seed-level and summary tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pairforge.operators.metrics import (
    WEIGHT,
    agreeing_weights,
    all_metrics,
    external_average,
    seed_groups,
    seed_level,
    summarize_seeds,
)


def seed_detail(
    predictions: DataFrame, first: str, second: str, measure: Callable[[DataFrame], DataFrame] = all_metrics
) -> DataFrame:
    """Seed-level metrics of all cohorts and of the external average.

    ``predictions`` hold one row per weight and unit (``metrics.keep_first``). Weights that lack
    units, or that differ in an outcome, are an error. ``measure`` gives the metrics per weight;
    ``metrics.weight_metrics`` leaves out those that need the predictions in order.
    """
    groups = seed_groups(predictions).join(agreeing_weights(predictions).select(*WEIGHT, "n"), list(WEIGHT))
    detail = seed_level(measure(predictions), groups)
    return detail.unionByName(external_average(detail, first, second))


def seed_summary(predictions: DataFrame, first: str, second: str) -> DataFrame:
    return summarize_seeds(seed_detail(predictions, first, second))
