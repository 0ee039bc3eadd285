"""Registered queries: library operators bound to the test tables, with SQL twins."""

from workload import (  # noqa: F401
    aggregates,
    comparison,
    ingestion,
    listings,
    quality,
    reports,
    samples,
    sources,
)
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
