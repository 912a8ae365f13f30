"""Shared by the tests and by bench: a Spark session, a DuckDB connection and a row comparison."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb
from pyspark.sql import SparkSession

DATA = os.environ.get("TESTDATA_ROOT", "/root/testdata")


def session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("kpivane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (decimal.Decimal, int)):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day).isoformat()
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(frame, con: duckdb.DuckDBPyConnection, sql: str, show: int = 3) -> str | None:
    """None when both sides hold the same rows, else a short report."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    ours = rows_of(frame.columns, frame.collect())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if ours == theirs:
        return None if ours else "no rows on either side"
    a, b = set(ours), set(theirs)
    return (f"{len(ours)} rows vs {len(theirs)}; only ours {sorted(a - b, key=repr)[:show]}; "
            f"only theirs {sorted(b - a, key=repr)[:show]}")
