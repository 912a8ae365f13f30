"""All registered queries. Importing the modules registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (  # noqa: F401
    queries_clusters, queries_cube, queries_features, queries_kpi, queries_learned, queries_signals, queries_store, queries_text,
)
from .registry import QUERIES, SQL, runner


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(function) for name, function in QUERIES.items()}


def sql() -> dict[str, str]:
    return dict(SQL)
