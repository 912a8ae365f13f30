"""Result tables on disk that are rewritten by key, and read page by page in order of time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stage import settled
from .store import PAGE_LIMIT

MARK = "__mark"


class KeyedTable:
    """A Parquet table in folders by a hash of its key: a change rewrites only the folders that it touches.

    Rows of one key share a folder. A change reads the touched folders, writes the merged rows to the shared
    stage folder and then replaces the folders, so it can be repeated after it broke off, with the same
    result. Each rewritten folder has one mark row, so that a folder whose rows all go is replaced too.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")
        return rows.withColumn("bucket", bucket)

    def _stored(self, buckets: Sequence[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(list(buckets)))
        return rows.where(~F.col(MARK)).drop(MARK, "bucket")

    def read(self) -> DataFrame:
        return self._stored()

    def create(self, rows: DataFrame) -> None:
        """Write the table anew."""
        self._write(rows, list(range(self.buckets)), "static")

    def _write(self, rows: DataFrame, buckets: Sequence[int], mode: str) -> None:
        marks = self.spark.createDataFrame([(b, True) for b in buckets], f"bucket int, {MARK} boolean")
        whole = self._placed(rows).withColumn(MARK, F.lit(False)).unionByName(marks, allowMissingColumns=True)
        whole.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", mode).parquet(self.path)

    def change(self, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Put `merge(stored rows of the touched folders, incoming)` in place of the stored rows; gives the touched folders.

        `merge` must keep every row of a key that it does not change. The folders are those of the keys of `incoming`.
        """
        held = settled(self._placed(incoming))
        buckets = sorted(r["bucket"] for r in held.select("bucket").distinct().collect())
        if buckets:
            self._write(settled(merge(self._stored(buckets), held.drop("bucket"))), buckets, "dynamic")
        return buckets

    def replace(self, keys: DataFrame, rows: DataFrame) -> list[int]:
        """Take away the rows of some keys and put `rows` (of these keys) in; other keys stay as they are."""
        wanted = keys.select(*self.keys).distinct()
        fresh = settled(rows.join(wanted, self.keys, "left_semi"))

        def merge(stored: DataFrame, gone: DataFrame) -> DataFrame:
            return stored.join(gone, self.keys, "left_anti").unionByName(fresh, allowMissingColumns=True)

        return self.change(wanted, merge)


class TimeTable:
    """A Parquet table in folders by month, for pages that go from the newest row to older ones.

    A page continues after the time and id of the last row shown. It reads the months from there on, more
    only where these hold too few rows; rows already shown are neither sorted nor counted.
    """

    def __init__(self, spark: SparkSession, path: str, time: str, tie: str) -> None:
        self.spark, self.path, self.time, self.tie = spark, path, time, tie

    def append(self, rows: DataFrame) -> None:
        month = F.trunc(F.col(self.time).cast("date"), "month")
        placed = rows.withColumn("month", month).hint("rebalance", "month").sortWithinPartitions("month", F.desc(self.time), self.tie)
        placed.write.partitionBy("month").mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def months(self, until: date | None = None) -> list[date]:
        """Months of the table, the newest first; only folder names and row counts are read."""
        found = sorted((r["month"] for r in self.read().select("month").distinct().collect() if r["month"] is not None), reverse=True)
        return [m for m in found if until is None or m <= until]

    def page_after(self, limit: int = 500, last: tuple[datetime, Any] | None = None, where: Column | None = None) -> DataFrame:
        """The next rows, newest first, ties by id; from the newest row on without `last`. Rows without a time are in no page."""
        limit = max(1, min(limit, PAGE_LIMIT))
        rows = self.read() if where is None else self.read().where(where)
        time, tie = F.col(self.time), F.col(self.tie)
        if last is not None:
            rows = rows.where((time < F.lit(last[0])) | ((time == F.lit(last[0])) & (tie > F.lit(last[1]))))
        months = self.months(None if last is None else last[0].date().replace(day=1))
        taken = 1
        while True:
            some = rows.where(F.col("month").isin(months[:taken])) if months else rows.where(F.lit(False))
            if taken >= len(months) or some.limit(limit).count() >= limit:
                return some.orderBy(F.desc(self.time), self.tie).limit(limit).drop("month")
            taken *= 2
