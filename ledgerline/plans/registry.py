"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.views import Market, sql_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of the Market as query `name`, with its oracle."""

    def add(f: Callable[[Market], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: f(Market(spark, folder))
        if sql:
            ORACLES[name] = sql_of(sql)
        return f

    return add
