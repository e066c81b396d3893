"""Queries by name, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers the decorated plan under its own name; sql gives the same rows in DuckDB."""

    def register(plan):
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return register
