from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` under its name, with its check in SQL."""

    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def sql() -> dict[str, str]:
    return dict(_SQL)


def renamed(fn: Query, name: str) -> Query:
    """The same query to be registered under another name."""

    def same(spark: SparkSession, sf: str) -> DataFrame:
        return fn(spark, sf)

    same.__name__ = name
    return same
