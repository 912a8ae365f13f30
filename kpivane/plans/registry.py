"""Registry of named queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

QueryFunction = Callable[[Tables], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFunction], QueryFunction]:
    """Register a query over a folder of tables, with its SQL where SQL can say the same."""
    def add(function: QueryFunction) -> QueryFunction:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def runner(function: QueryFunction) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Tables(spark, sf_dir))

    run.__name__ = function.__name__
    run.__doc__ = function.__doc__
    return run
