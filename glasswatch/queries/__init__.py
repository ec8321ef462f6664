"""Registered queries, each next to the SQL that checks it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glasswatch.operators.scan import BATCH_BYTES
from glasswatch.sources.readers import balanced, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows carry long text, spread over the cores."""
    return balanced(table(spark, sf, name))


def load_all() -> None:
    from glasswatch.queries import detection, fleet, inventory, policy, sessions, streams, weighted  # noqa: F401


__all__ = ["QUERIES", "SQL", "query", "table", "texts", "load_all"]
