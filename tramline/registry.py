"""Queries over the test tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.adapter import ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "") -> Callable:
    """Registers a query. sql: its oracle, which may name the adapter's tables listed in uses."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {ctes(*uses.split())}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}" if uses else sql
        return f

    return add
