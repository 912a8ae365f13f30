"""MinHash near-duplicates with odd sketches.

One pass gives each text its shingle-set key, banded MinHash keys and an odd sketch: the parity bitmap
of its MinHash samples. Texts with equal sets become one class. Classes that share a band key are
compared in two steps, neither of which makes all pairs of a group:

1. each class with the smallest class of the bucket;
2. in buckets whose classes still lie in different components, classes of different components, as
   tiles of bounded size inside tasks that return only pairs whose sketches are close.

The population count of two sketches' XOR estimates the similarity and drops pairs that are far below
the threshold; the rest is decided on the full shingle sets. A pair that shares a bucket is therefore
either compared or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import settled
from .graph import components
from .words import mixed, odd_numbers, runs, shingle_sets, slices

TILE = 1024
SKETCHED = 256


class Sketching(NamedTuple):
    """`bands` x `rows` MinHash samples for the bands, and `samples` more in the odd sketch of `bits` bits.

    At similarity 0.75 a pair shares no band with probability (1 - 0.75^rows)^bands.
    """

    shingle: int = 5
    rows: int = 4
    bands: int = 28
    samples: int = 512
    bits: int = 4096
    percent: int = 75

    def sketch_limit(self) -> int:
        """Largest XOR population count kept: 4.5 standard deviations above that of a pair at the threshold."""
        p = 1 - self.percent / 100
        flips = 2 * self.samples * p
        mean = self.bits / 2 * (1 - (1 - 2 / self.bits) ** flips)
        # Two flips for each sample that differs; flips that meet in one bit cancel out.
        return math.ceil(mean + 4.5 * math.sqrt(4 * self.samples * p * (1 - p) + 2 * flips**2 / self.bits))


def _sketches(sets: list[np.ndarray], how: Sketching) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n x bands, int64) and odd sketches (n x bits / 64, int64), some texts at a time."""
    parts = [_sketch(sets[i : i + SKETCHED], how) for i in range(0, max(1, len(sets)), SKETCHED)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sketch(sets: list[np.ndarray], how: Sketching) -> tuple[np.ndarray, np.ndarray]:
    banded = how.rows * how.bands
    samples = banded + how.samples
    factor, shift = (odd_numbers(seed, samples).astype(np.uint32) for seed in (31, 37))
    least = np.zeros((len(sets), samples), np.uint32)
    for i, one in enumerate(sets):
        short = (one >> np.uint64(32)).astype(np.uint32)
        step = max(1, (1 << 17) // max(1, len(one)))
        for j in range(0, samples if len(one) else 0, step):
            least[i, j : j + step] = (short[None, :] * factor[j : j + step, None] + shift[j : j + step, None]).min(axis=1)
    weighed = least.astype(np.uint64) * odd_numbers(41, samples)
    bands = weighed[:, :banded].reshape(len(sets), how.bands, how.rows).sum(axis=2, dtype=np.uint64)
    bands = mixed(bands + np.arange(how.bands, dtype=np.uint64))
    place = mixed(weighed[:, banded:] + np.arange(how.samples, dtype=np.uint64)) % np.uint64(how.bits)
    flat = np.arange(len(sets))[:, None] * how.bits + place.astype(np.int64)
    parity = np.bincount(flat.ravel(), minlength=len(sets) * how.bits) & 1
    odd = np.packbits(parity.astype(np.uint8).reshape(len(sets), how.bits), axis=1).view(np.int64)
    return bands.view(np.int64), odd


def signatures(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """doc_id, n_shingles, set_key, bands and odd of every whole text; null keys where there are no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), how.shingle)
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                # Sums of two mixes of the elements: equal sets have equal keys.
                keys = [f"{int(mixed(s).sum()) if len(s) else 0:016x}{int(mixed(s ^ np.uint64(0x5DEECE66D)).sum()) if len(s) else 0:016x}" for s in sets]
                bands, odd = _sketches(sets, how)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                         for x in (bands, odd)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sizes), pa.array([k if n else None for k, n in zip(keys, sizes, strict=True)], pa.string()), *lists],
                    names=["doc_id", "n_shingles", "set_key", "bands", "odd"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key string, bands array<bigint>, odd array<bigint>")


def _close(pairs: DataFrame, classes: DataFrame, how: Sketching) -> DataFrame:
    """Pairs (a, b) whose odd sketches differ in few enough bits."""
    def odd(side):
        return classes.select(F.col("doc_id").alias(side), F.col("odd").alias(f"odd_{side}"))
    apart = F.expr("aggregate(zip_with(odd_a, odd_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    return pairs.join(odd("a"), "a").join(odd("b"), "b").where(apart <= how.sketch_limit()).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, how: Sketching) -> DataFrame:
    """Pairs (a, b) that reach the threshold on their full shingle sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                left, right = (shingle_sets(part.column(c), how.shingle) for c in ("text_a", "text_b"))
                same = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)), np.int64)
                every = np.fromiter((len(x) + len(y) for x, y in zip(left, right, strict=True)), np.int64) - same
                yield part.select(["a", "b"]).filter(pa.array(100 * same >= how.percent * every))

    def text(side):
        return texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _across(shared: DataFrame, comps: DataFrame, classes: DataFrame, how: Sketching) -> DataFrame:
    """Pairs of classes that share a bucket, lie in different components and have close sketches.

    Buckets inside one component are done. In the others each class outside the bucket's main
    component (the one of its smallest class) meets all classes of the bucket, dealt to tiles.
    """
    placed = shared.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    main = placed.where("id = first").select("key", F.col("component").alias("main"))
    sized = placed.join(main, "key").withColumn("minor", F.col("component") != F.col("main"))
    live = sized.groupBy("key").agg(F.count_if("minor").alias("minors")).where("minors > 0")
    sized = sized.join(live, "key").join(classes.select(F.col("doc_id").alias("id"), "odd", "bands"), "id")
    tiles, rows = F.ceil(F.col("members") / TILE).cast("int"), F.ceil(F.col("minors") / TILE).cast("int")
    carried = ["key", "id", "component", "odd", "bands"]
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    # The bucket's smallest class has met all others in the first step.
    all_of = sized.where("id <> first").select(*carried, F.lit(False).alias("asks"), own.alias("tile"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("row"))
    asking = sized.where("minor").select(
        *carried, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"),
        F.pmod(F.xxhash64(F.col("id") + 1), rows).cast("int").alias("row"))
    limit, place = how.sketch_limit(), ["key", "tile", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, place):
            asks = group.column("asks").to_numpy(zero_copy_only=False)
            ids, comp = group.column("id").to_numpy(), group.column("component").to_numpy()
            odd, bands = (group.column(c).flatten().to_numpy().reshape(len(ids), -1) for c in ("odd", "bands"))
            odd = odd.view(np.uint64)  # the count of a signed number is that of its absolute value
            bands = bands[:, : int(np.argmax(bands[0] == group.column("key")[0].as_py()))]
            found = []
            there = np.flatnonzero(~asks)
            for i in np.flatnonzero(asks):
                near = there[comp[there] != comp[i]]
                near = near[np.bitwise_count(odd[near] ^ odd[i]).sum(axis=1) <= limit]
                # A pair that shares several bands counts in the first.
                near = near[~(bands[near] == bands[i]).any(axis=1)]
                found.append(np.stack([np.minimum(ids[near], ids[i]), np.maximum(ids[near], ids[i])], axis=1))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    dealt = all_of.unionByName(asking).repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id and kept.

    Links join documents whose shingle sets have a Jaccard similarity of at least `percent` / 100.
    component_id is the smallest doc_id reachable; kept says that it is the row's own. Texts that are
    null, empty or without words have no shingles and stand alone. A null doc_id has no component and
    is kept. Rows that share a doc_id share its result (the class of the smallest set key, if their
    texts differ). Other columns are ignored; no rows give no rows.
    """
    signed = settled(signatures(docs, how))
    classes = settled(
        signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "bands", "odd")).alias("one")).select("set_key", "one.*"))
    keys = classes.select("doc_id", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")).where("members > 1")
    shared = settled(keys.join(full, "key").select("key", F.col("doc_id").alias("id"), "first", "members"))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    texts = settled(texts.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    stars = shared.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    linked = settled(_confirmed(_close(stars, classes, how), texts, how))
    comps = components(linked, "a", "b")
    more = _across(shared, comps, classes, how)
    linked = linked.unionByName(_confirmed(more, texts, how))
    comps = components(linked, "a", "b")
    named = classes.join(comps, F.col("doc_id") == F.col("node"), "left").select(
        "set_key", F.coalesce("component", "doc_id").alias("_component"))
    best = F.coalesce("_component", "doc_id")
    return signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select(
        "doc_id", "n_shingles", best.alias("component_id"), F.coalesce(best == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, how: Sketching = Sketching()) -> DataFrame:
    """The rows of `docs` that near_duplicates keeps, with their columns; of repeated ids one row stays."""
    found = near_duplicates(docs, how)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, F.col("doc_id").cast("bigint") == F.col("_gone"), "left_anti")
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles
  FROM said
), each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS both_n, count(*) AS same
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * same >= 75 * (both_n - same)
  UNION ALL SELECT b, a FROM shared WHERE 100 * same >= 75 * (both_n - same)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, r.component_id, r.component_id = s.doc_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""
