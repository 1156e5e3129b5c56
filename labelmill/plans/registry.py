"""Queries and their DuckDB SQL, registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Hand-worked cases on a few stated rows, with what they must give: for tests, not registered as queries.
GOLDENS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
GOLDEN_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with SQL for the same rows if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def golden(name: str, sql: str):
    """Keep a function of (spark, sf_dir) on stated rows as a hand-worked case."""

    def add(f):
        GOLDENS[name], GOLDEN_SQL[name] = f, sql
        return f

    return add
