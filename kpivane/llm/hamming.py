"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into m segments. When the first a segments have been probed within r bits and the others
within r - 1, every code within Hamming distance m * r + a - 1 of a query has been met, so that
distance is covered. The radius grows a few segments at a time, and only for queries whose k-th
verified distance is not covered.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import settled

BITS = 64
#: Codes from which segments of 16 bits are used instead of 8: about 2^6 codes share a value then.
WIDE_FROM = 1 << 20


def sign_code(vector: Column | str) -> Column:
    """A 64-bit code: bit i is set when the components i, i + 64, ... add up to more than 0.

    NULL for a null or empty vector and for one with a null or non-finite component.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wide = F.transform(v, lambda x: x.cast("double"))
    bit = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.when(
        F.aggregate(F.filter(wide, lambda x, j: j % BITS == i), F.lit(0.0), lambda s, x: s + x) > 0, F.lit(1)).otherwise(F.lit(0)))
    number = F.aggregate(bit, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b.cast("bigint")))
    return F.when(sound, number)


def _masks(bits: int, changed: int) -> list[int]:
    return [sum(1 << b for b in chosen) for chosen in combinations(range(bits), changed)]


def _segment(code: Column, s: Column, width: int) -> Column:
    return F.call_function("shiftrightunsigned", code, (s * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def top_k(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and distance: for each query the `k` nearest other rows, ties by vec_id.

    `codes` and `queries` hold vec_id and a 64-bit code. Rows with a null id or code take no part; a row
    with the query's own id is not its neighbour; repeated rows of one id count once. Fewer than `k`
    other rows give them all; empty inputs give no rows. Equal codes are searched once: each keeps its
    k + 1 smallest ids, so a crowd of copies costs no more than one code.
    """
    sound = codes.select(F.col("vec_id").cast("bigint"), F.col("code").cast("bigint")).where(
        "vec_id is not null and code is not null").distinct()
    order = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    index = settled(sound.withColumn("_n", order).where(F.col("_n") <= k + 1)
                    .groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = queries.select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("code").cast("bigint").alias("query")).where(
        "query_id is not null and query is not null").distinct()
    open_queries = settled(asked.select("query").distinct())
    width = 16 if index.count() >= WIDE_FROM else 8
    segments = BITS // width
    numbers = F.array(*[F.lit(s) for s in range(segments)])
    tables = index.select("code", F.explode(numbers).alias("s")).withColumn("value", _segment(F.col("code"), F.col("s"), width))
    found, known = None, -1
    some = segments // 4
    for radius, ahead in [(0, segments), *[(r, a) for r in range(1, width + 1) for a in range(some, segments + 1, some)]]:
        covered = segments * radius + ahead - 1
        probes = open_queries.select("query", F.explode(numbers).alias("s")).withColumn("own", _segment(F.col("query"), F.col("s"), width))
        masks = [m for changed in range(radius + 1) for m in _masks(width, changed)]
        mask_table = F.explode(F.array(*[F.lit(m) for m in masks])) if len(masks) < 3000 else F.explode(
            F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda x: F.bit_count(x) <= radius))
        reach = F.when(F.col("s") < ahead, radius).otherwise(radius - 1)
        probes = probes.select("query", "s", mask_table.alias("mask"), "own").where(F.bit_count("mask") <= reach).withColumn(
            "value", F.col("own").bitwiseXOR(F.col("mask").cast("bigint")))
        apart = F.col("query").bitwiseXOR(F.col("code"))
        # A code counts in the round that first covers its distance, in the first segment that is near enough.
        earlier = F.lit(False)
        for other in range(segments - 1):
            near = F.bit_count(_segment(apart, F.lit(other), width)) <= (radius if other < ahead else radius - 1)
            earlier = earlier | ((F.col("t.s") > other) & near)
        # Both sides grow with the data, and the planner does not see by how much: neither is broadcast.
        hits = probes.hint("merge").alias("p").join(tables.alias("t"), (
            (F.col("p.s") == F.col("t.s")) & (F.col("p.value") == F.col("t.value"))
            & F.bit_count(apart).between(known + 1, covered) & ~earlier))
        fresh = hits.select("query", "code", F.bit_count(apart).alias("distance"))
        ids = fresh.join(index, "code").select("query", "distance", F.explode("ids").alias("vec_id"))
        ids = ids if found is None else found.unionByName(ids)
        best = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
        found = settled(ids.withColumn("_n", best).where(F.col("_n") <= k + 1).drop("_n"))
        full = found.groupBy("query").agg(F.count("*").alias("_n")).where(F.col("_n") >= k + 1)
        open_queries = settled(open_queries.join(full, "query", "left_anti"))
        known = covered
        if covered >= BITS or open_queries.isEmpty():
            break
    answers = asked.join(found, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
