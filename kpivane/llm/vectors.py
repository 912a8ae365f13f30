"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index tables, exact rerank.

Rotations that balance the signs of the projected vectors are learned on a bounded sample, as many as a
pair at the threshold needs; misses are measured on pairs of the sample, whatever direction its vectors
share. Codes are cut into segments, wider ones for larger labels; vectors of one label that agree in a segment meet in a table bucket and are
compared by cosine in double precision. Buckets are cut into tiles, so a task holds two tiles at most,
and a tile returns counts and a spanning set of links instead of all pairs. A pair that meets in
several tables counts in the first.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import settled
from .graph import components
from .words import runs

SAMPLE = 10_000
TILE = 2_048
MISSED = 1e-3
PROBES = 2_000


def learn(sample: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation (dims x bits): principal directions, then rotation and signs fitted to each other in turn.

    Nothing is subtracted from the vectors: only the angle of the vectors themselves is known for a pair at the threshold.
    """
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(sample.T @ sample + 1e-9 * np.eye(sample.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    turn, _ = np.linalg.qr(rng.normal(size=(bits, bits)))
    projected = sample @ axes
    for _ in range(rounds):
        signs = np.where(projected @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        turn = right.T @ left.T
    return axes @ turn


def unfitted(dims: int, bits: int, seed: int) -> np.ndarray:
    """Random hyperplanes (dims x bits): any two vectors agree in a sign with the chance that their angle gives."""
    return np.random.default_rng([seed, dims]).normal(size=(dims, bits))


def segment_bits(members: Column) -> Column:
    """Width of the table keys of a label: about as many keys as it has tiles of 64 vectors, from 8 to 16 bits."""
    return F.least(F.lit(16), F.greatest(F.lit(8), F.round(F.log2(F.greatest(F.lit(2.0), members / 64))).cast("int")))


def table_count(width: int, cosine: float) -> int:
    """Tables needed so that a pair at the threshold shares none with a probability of at most MISSED."""
    agree = (1 - math.acos(cosine) / math.pi) ** width
    return math.ceil(math.log(MISSED) / math.log(1 - agree)) if agree < 1 else 1


def table_keys(unit: np.ndarray, matrices: list[np.ndarray], width: int) -> np.ndarray:
    """(n x tables) segment values of unit vectors."""
    out = []
    for m in matrices:
        signs = (unit @ m > 0).astype(np.int64)
        out += [signs[:, i : i + width] @ (1 << np.arange(width)) for i in range(0, m.shape[1] - width + 1, width)]
    return np.stack(out, axis=1)


def threshold_pairs(x: np.ndarray, cosine: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors to measure misses on: partners at the threshold in random directions and in those of
    other vectors of the sample, and the sample's own pairs above the threshold."""
    rng = np.random.default_rng(0)
    x = x[:PROBES]

    def partners(direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        across = direction - (direction * x).sum(axis=1, keepdims=True) * x
        length = np.linalg.norm(across, axis=1, keepdims=True)
        some = length[:, 0] > 1e-6
        return x[some], cosine * x[some] + math.sqrt(1 - cosine * cosine) * across[some] / length[some]

    a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    if len(a) > 10 * PROBES:
        pick = rng.choice(len(a), 10 * PROBES, replace=False)
        a, b = a[pick], b[pick]
    return [partners(rng.normal(size=x.shape)), partners(x[rng.permutation(len(x))]), (x[a], x[b])]


def matrices_for(x: np.ndarray, dims: int, width: int, cosine: float) -> list[np.ndarray]:
    """Projections whose tables of `width` bits keep the misses at MISSED: fitted to the unit vectors `x`, and where
    these miss more of the measured pairs (or there are no vectors), unfitted ones beside them, enough on their own."""
    bits = min(64, dims)
    count = math.ceil(table_count(width, cosine) / (bits // width))
    own = [learn(x, bits, seed) for seed in range(count)] if len(x) else []

    def missed(one: np.ndarray, two: np.ndarray) -> float:
        return float((table_keys(one, own, width) != table_keys(two, own, width)).all(axis=1).mean()) if len(one) else 0.0

    if not own or any(missed(*pair) > MISSED for pair in threshold_pairs(x, cosine)):
        own += [unfitted(dims, bits, seed) for seed in range(count)]
    return own


def _matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float32).reshape(len(column), -1)


def near_vectors(vectors: DataFrame, cosine: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id and kept.

    Only vectors with equal, not null labels and equal dimensions are compared. A vector that is null,
    empty, zero or holds null or non-finite components links with nothing, and so does a null vec_id
    (its component is null and it is kept). Rows with one vec_id should be one row: repeated ones are
    separate vectors that share the id's component. Equal vectors of a label are compared once and
    counted as often as they occur. Other columns are ignored; no rows give no rows.
    """
    parts = vectors.select(F.col("vec_id").cast("bigint"), F.col("label"), F.col("embedding").cast("array<float>").alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound, F.lit(False))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(x, np.float32).tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["vec_id", "label", "bytes"])

    label_type = parts.schema["label"].dataType.simpleString()
    packed = parts.where(usable).mapInArrow(pack, f"vec_id bigint, label {label_type}, bytes binary")
    classes = settled(packed.groupBy("label", "bytes").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    sizes = {r[0]: r[1] for r in classes.groupBy(F.length("bytes")).agg(F.count("*")).orderBy(F.desc("count(1)")).limit(64).collect()}
    counted_labels = classes.groupBy("label").agg(F.count("*").alias("_members"))
    # Labels that need more than the least width: each has thousands of vectors, so they are few.
    wide = settled(counted_labels.select("label", segment_bits(F.col("_members")).alias("_width")).where("_width > 8"))
    widths = sorted({8, *[r[0] for r in wide.select("_width").distinct().collect()]})
    projections: dict[tuple[int, int], list[np.ndarray]] = {}
    for size in sizes:
        dims = size // 4
        some = classes.where(F.length("bytes") == size).orderBy(F.xxhash64("id")).limit(sample).select("bytes").toArrow()["bytes"]
        x = np.frombuffer(b"".join(some.to_pylist()), np.float32).reshape(-1, dims).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for width in {min(w, 64, dims) for w in widths}:
            projections[dims, width] = matrices_for(x, dims, width, cosine)

    def keys_of(x: np.ndarray, width: int) -> np.ndarray:
        """Segment values of a label's vectors; dimensions too rare to have been seen have unfitted projections."""
        dims = x.shape[1]
        width = min(width, 64, dims)
        own = projections.get((dims, width)) or matrices_for(np.zeros((0, dims)), dims, width, cosine)
        unit = x.astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        return table_keys(unit, own, width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.binary_length(batch.column("bytes"))
            width = batch.column("width")
            for size, bits in itertools.product(pc.unique(length).to_pylist(), pc.unique(width).to_pylist()):
                some = batch.filter(pc.and_(pc.equal(length, size), pc.equal(width, bits))).drop_columns(["width"])
                if not some.num_rows:
                    continue
                keys = keys_of(_matrix(some.column("bytes")), bits).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=[*some.schema.names, "keys"])

    sized = classes.join(F.broadcast(wide), "label", "left").select(*classes.columns, F.coalesce("_width", F.lit(8)).alias("width"))
    coded_classes = settled(sized.mapInArrow(coded, f"label {label_type}, bytes binary, id bigint, copies bigint, keys array<int>"))
    bucket = ["label", "size", "nth", "key"]
    spread = coded_classes.select("label", F.length("bytes").alias("size"), "id", F.posexplode("keys").alias("nth", "key"))
    crowds = spread.groupBy(bucket).agg(F.count("*").alias("members")).where("members > 1")
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    placed = spread.join(crowds, bucket).join(coded_classes.select("id", "bytes", "copies", "keys"), "id")
    own = F.pmod(F.xxhash64("id"), tiles).cast("int")
    each = F.explode(F.sequence(F.lit(0), tiles - 1))
    carried = ["id", "bytes", "copies", "keys"]
    asks = placed.select(*bucket, *carried, F.lit(True).alias("asks"), own.alias("row"), each.alias("column"))
    asked = placed.select(*bucket, *carried, F.lit(False).alias("asks"), each.alias("row"), own.alias("column"))

    def compared(group: pa.RecordBatch) -> pa.RecordBatch:
        nth = group.column("nth")[0].as_py()
        asking = group.column("asks")
        left, right = group.filter(asking), group.filter(pc.invert(asking))
        a, b = left.column("id").to_numpy(), right.column("id").to_numpy()
        if not len(a) or not len(b):
            return pa.RecordBatch.from_pylist([], schema=met_schema)
        one, two = (_matrix(g.column("bytes")).astype(np.float64) for g in (left, right))
        k1, k2 = (g.column("keys").flatten().to_numpy().reshape(g.num_rows, -1)[:, :nth] for g in (left, right))
        copies = right.column("copies").to_numpy()
        one /= np.linalg.norm(one, axis=1, keepdims=True)
        two /= np.linalg.norm(two, axis=1, keepdims=True)
        near = (one @ two.T >= cosine) & (a[:, None] != b[None, :])
        rows, columns = np.nonzero(near)
        first = np.ones(len(rows), bool)
        for i in range(nth):
            first &= k1[rows, i] != k2[columns, i]
        count = np.bincount(rows[first], copies[columns[first]], len(a)).astype(np.int64)
        # The smallest id that each reaches inside the tile: a spanning set of the tile's links.
        reach_a, reach_b, far = a, b, np.iinfo(np.int64).max
        while True:
            new_a = np.minimum(reach_a, np.where(near, reach_b[None, :], far).min(axis=1))
            new_b = np.minimum(reach_b, np.where(near, new_a[:, None], far).min(axis=0))
            if (new_a == reach_a).all() and (new_b == reach_b).all():
                break
            reach_a, reach_b = new_a, new_b
        some = near.any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x[some].astype(np.int64)) for x in (a, count, reach_a)], schema=met_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, [*number, "row", "column"]):
            yield compared(group)

    met_schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
    # One number stands for the bucket's values, whatever the type of the labels.
    number = ["nth", "_bucket"]
    dealt = asks.unionByName(asked).withColumn("_bucket", F.xxhash64(*[F.col(c).cast("string") for c in bucket])).select(
        *number, "row", "column", *carried, "asks")
    dealt = dealt.repartition(*number, "row", "column").sortWithinPartitions(*number, "row", "column")
    met = settled(dealt.mapInArrow(compare, "id bigint, links bigint, to bigint"))
    counted = met.groupBy("id").agg(F.sum("links").alias("_links"))
    comps = components(met, "id", "to")
    joined = (
        coded_classes.select("label", "bytes", "id", "copies").join(counted, "id", "left")
        .join(comps, F.col("id") == F.col("node"), "left")
        .select("label", "bytes", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "id").alias("_c"))
    )
    named = packed.join(joined, ["label", "bytes"]).select("vec_id", "_n", "_c")
    rest = parts.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("_n"), F.col("vec_id").alias("_c"))
    every = named.unionByName(rest)
    return every.select("vec_id", F.col("_n").alias("n_links"), F.col("_c").alias("component_id"),
                        F.coalesce(F.col("_c") == F.col("vec_id"), F.lit(True)).alias("kept"))


NEAR_VECTORS_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.other) AS component_id, min(r.other) = r.vec_id AS kept
FROM reach r LEFT JOIN counted c ON c.a = r.vec_id GROUP BY r.vec_id
"""
