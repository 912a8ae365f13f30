"""Access to a folder of Parquet tables, and reads with declared types."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """`tables("orders")` reads `<root>/orders.parquet`; pruning and pushdown stay with Spark.

    A table's schema is read from its footers once, not at every mention.
    """

    spark: SparkSession
    root: str
    known: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def __call__(self, name: str) -> DataFrame:
        if name not in self.known:
            self.known[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self.known[name]


@dataclass(frozen=True)
class CatalogTables:
    """The same over tables of the session's catalog, which may be partitioned or bucketed."""

    spark: SparkSession
    database: str = "default"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")


def save_bucketed(frame: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Store a table in buckets of a join key.

    A fact and a dimension too large to broadcast then join without a shuffle of the fact when
    both have the same number of buckets. Not for a key of which one value holds a large share
    of the rows: there the shuffled join, which Spark splits at run time, is the better way.
    """
    writer = frame.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def typed(column: Column, type_name: str) -> Column:
    """A text value as the declared type; anything unreadable becomes NULL."""
    if type_name == "boolean":
        return F.when(column == "true", True).when(column == "false", False)
    if type_name in ("double", "float"):
        value = column.try_cast("double")
        return F.when(~F.isnan(value), value)
    if type_name == "string":
        return column
    return column.try_cast(type_name)


def typed_read(frame: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Coerce the text columns named in `schema`; columns the frame lacks are passed over."""
    known = {name.lower(): name for name in frame.columns}
    return frame.select(
        *[typed(F.col(known[c.lower()]), t).alias(c) for c, t in schema.items() if c.lower() in known]
    )
