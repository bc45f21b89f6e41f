"""Imports every query module, so that the registry is complete."""

from workload import (  # noqa: F401
    queries_audit,
    queries_augment,
    queries_contracts,
    queries_evaluation,
    queries_pairs,
    queries_scoring,
    queries_sources,
    queries_text,
)
from workload.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
