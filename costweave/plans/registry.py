"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from costweave.functions.scalars import half_up

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(c: Column, digits: int = 4) -> Column:
    return half_up(c, digits)


def sql_r(expression: str, digits: int = 4) -> str:
    scale = f"1e{digits}"
    return f"floor(({expression}) * {scale} + 0.5e0) / {scale}"
