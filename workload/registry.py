"""Registry of queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.sqlviews import with_views
from workload.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(views) -> DataFrame``; ``sql`` may use any fixture view by name."""

    def register(build: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Views(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            CHECK_SQL[name] = with_views(sql)
        return build

    return register


def r6(column: Column | str) -> Column:
    """Six digits, by the same arithmetic as ``r6`` in the check SQL.

    The offset keeps decimal ties away from the cut, where engines differ.
    """
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column.cast("double") * 1e6 + 0.5137).cast("double") / 1e6


def rounded(df: DataFrame) -> DataFrame:
    """All DOUBLE columns through ``r6``."""
    return df.select(
        *[r6(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    )
