"""Connected components of an edge table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import settled


def _nearest(edges: DataFrame, of: str, to: str) -> DataFrame:
    return edges.groupBy(of).agg(F.min(to).alias("_least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours of its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _nearest(both, "u", "v").withColumn("_least", F.least("_least", "u"))
    told = both.where("v > u").join(least, "u")
    return told.select(F.col("v").alias("u"), F.col("_least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the smallest of them; edges have u > v."""
    least = _nearest(edges, "u", "v")
    told = edges.join(least, "u").where("v > _least").select(F.col("v").alias("u"), F.col("_least").alias("v"))
    return told.unionByName(least.select("u", F.col("_least").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """`(node, component)` for every node of an edge but those that are their own component's smallest.

    The component is the smallest node reachable. Null ends and loops are ignored, repeated edges
    count once, no edges give no rows. Each round halves distances with grouped minima and joins (no
    group is gathered) and is written to the shared folder; rounds grow with the logarithm of the size.
    """
    now = settled(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.expr("u > v")).distinct())
    state = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (found["n"], found["s"]) == state or not found["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = found["n"], found["s"]
        now = settled(_small_star(_large_star(now)))
