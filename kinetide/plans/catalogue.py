"""The query catalogue: each entry applies one group of operators to the sample tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import instructions, recovery, reports, runs, segments, sources, storage, tables, temporal, vectors

FLAGSHIP = "interval_report"
ALL = temporal.QUERIES | vectors.QUERIES | tables.QUERIES | segments.QUERIES | runs.QUERIES | instructions.QUERIES | recovery.QUERIES | storage.QUERIES | reports.QUERIES | sources.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB; draws by hash and walks through a key's rows in order have none."""
    return {name: sql for name, (_, sql) in ALL.items() if sql}
