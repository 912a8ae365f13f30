"""Exact k-means over integer vectors with zone maps of blocks in Hilbert order.

Vectors are ordered along a Hilbert curve through their main directions and cut into blocks that carry the
least and greatest value of every component. The box of a block bounds the distance from any of its vectors
to a centroid from both sides: a centroid that is farther from the whole box than another is from the box's
far corner cannot be the nearest of any vector in it. Only the centroids that remain are compared, exactly. A
block with one candidate is settled by the sums that it carries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import settled

DIMS = 64
SCALE = 256
SAMPLE = 10_000
AXES, BITS = 8, 7
BLOCK = 512
#: Components up to here keep every squared distance inside 64 bits; up to EXACT inside the 53 of a double.
MOST, EXACT = 1 << 27, 1 << 22


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (n x axes, whole numbers below 2 ** bits) on the Hilbert curve; axes * bits at most 63."""
    x = points.astype(np.int64).copy()
    axes = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(axes):
            far = (x[:, i] & level) > 0
            x[far, 0] ^= low
            swap = np.where(far, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[:, -1] & level) > 0, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def main_axes(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions of greatest spread (dims x AXES) with the range of the sample along each. They only set the order."""
    if not len(sample):
        return np.zeros((DIMS, AXES)), np.zeros(AXES), np.ones(AXES)
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :AXES]
    along = sample @ axes
    low, high = along.min(axis=0), along.max(axis=0)
    return axes, low, np.where(high > low, high - low, 1.0)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids (ascending) that can be nearest to a vector between `low` and `high`."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    corner = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    return np.flatnonzero((outside * outside).sum(axis=1) <= (corner * corner).sum(axis=1).min())


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the number of the nearest centroid (ties: the smaller) and the squared distance, exact."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if largest < EXACT:
        a, b = vectors.astype(np.float64), centroids.astype(np.float64)
        # Every product and sum is a whole number below 2 ** 53.
        apart = (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        choice = apart.argmin(axis=1)
        return choice, (apart[np.arange(len(a)), choice] + (a * a).sum(axis=1)).astype(np.int64)
    apart = np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    choice = apart.argmin(axis=1)
    return choice, apart[np.arange(len(vectors)), choice]


def _ints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, DIMS).astype(np.int64)


def zone_blocks(vectors: DataFrame, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """`ids` (array), `data`, `low`, `high` (binary int32) and `sums` (binary int64): blocks of vectors in Hilbert order.

    `vectors` has vec_id and `data`. Equal places on the curve are dealt on by the hash of the vector and
    its id, so a vector that repeats often does not fill one task.
    """
    some = vectors.orderBy(F.xxhash64("vec_id", "data")).limit(sample).select("data").toArrow()["data"].combine_chunks()
    axes, least, spread = main_axes(_ints(some).astype(np.float64))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (_ints(batch.column("data")) @ axes - least) / spread
                grid = np.clip(share * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                yield batch.append_column("place", pa.array(hilbert_index(grid, BITS)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                rows = pa.concat_batches(held)
                whole = rows.num_rows - rows.num_rows % block
                for i in range(0, whole, block):
                    yield one(rows.slice(i, block))
                held = [rows.slice(whole)] if whole < rows.num_rows else []
        if held and (rows := pa.concat_batches(held)).num_rows:
            yield one(rows)

    def one(rows: pa.RecordBatch) -> pa.RecordBatch:
        x = _ints(rows.column("data"))
        parts = [x.astype(np.int32), x.min(axis=0).astype(np.int32), x.max(axis=0).astype(np.int32), x.sum(axis=0)]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
            names=["ids", "data", "low", "high", "sums"])

    dealt = vectors.mapInArrow(placed, "vec_id bigint, data binary, place bigint")
    order = ["place", "_tie"]
    ordered = dealt.withColumn("_tie", F.xxhash64("data", "vec_id")).repartitionByRange(*order).sortWithinPartitions(*order)
    return settled(ordered.select("vec_id", "data").mapInArrow(cut, "ids array<bigint>, data binary, low binary, high binary, sums binary"))


def _row_vectors(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(row["data"], np.int32).reshape(-1, DIMS).astype(np.int64)
    return x, *[np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("low", "high")], np.frombuffer(row["sums"], np.int64)


def cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """For each centroid with vectors: their number, summed distances and componentwise sums. One row per centroid comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for row in batch.to_pylist():
                x, low, high, sums = _row_vectors(row)
                able = candidates(low, high, centroids)
                choice, distance = nearest(x, centroids[able])
                for k in range(len(able)) if len(able) > 1 else ():
                    mine = choice == k
                    if mine.any():
                        held = total.setdefault(int(able[k]), [0, 0, [0] * DIMS])
                        held[0] += int(mine.sum())
                        held[1] += int(distance[mine].sum())
                        held[2] = [a + b for a, b in zip(held[2], x[mine].sum(axis=0).tolist(), strict=True)]
                if len(able) == 1:
                    held = total.setdefault(int(able[0]), [0, 0, [0] * DIMS])
                    held[0] += len(x)
                    held[1] += int(distance.sum())
                    held[2] = [a + b for a, b in zip(held[2], sums.tolist(), strict=True)]
        rows = [{"cluster": k, "measure": i, "total": str(v)} for k, h in total.items() for i, v in enumerate([h[0], h[1], *h[2]])]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cluster", pa.int32()), ("measure", pa.int32()), ("total", pa.string())]))

    found = blocks.mapInArrow(run, "cluster int, measure int, total string")
    summed = found.groupBy("cluster", "measure").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, list[int]] = {}
    for r in summed:
        out.setdefault(r["cluster"], [0] * (DIMS + 2))[r["measure"]] = int(r["total"])
    return {k: (v[0], v[1], v[2:]) for k, v in out.items()}


def candidate_counts(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`n_vectors, n_candidates` of each block: how much the zone maps rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(r["ids"]), len(candidates(*_row_vectors(r)[1:3], centroids))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32()) for i in (0, 1)], names=["n_vectors", "n_candidates"])

    return blocks.mapInArrow(run, "n_vectors int, n_candidates int")


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """`vec_id, data`: the vectors of DIMS finite components, each floor(SCALE * x), as binary int32."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == DIMS) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (SCALE * v).between(float(-MOST), float(MOST)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
            rows = np.floor(SCALE * flat).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "data"])

    kept = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("bigint"), x.alias("x"))
    return kept.mapInArrow(pack, "vec_id bigint, data binary")


def text_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, count: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """One row per kept row of `vectors` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are the vectors of exactly DIMS components without nulls, NaN or infinities (and without components
    beyond MOST / SCALE, whose squared distances no 64-bit integer can hold). The first centroids are those
    with the smallest hashes of `<seed>:<vec_id>`, fewer if there are fewer vectors; rows that share a vec_id
    are separate vectors in order of their components, and a null vec_id never starts a centroid. Ties go to
    the smaller number; a centroid without vectors stays. Other columns are ignored; no rows give no rows.
    """
    kept = settled(whole_vectors(vectors))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(named, "data").limit(count).select("data").toArrow()["data"].combine_chunks()
    centroids = _ints(first)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], schema)
    blocks = zone_blocks(kept)
    for _ in range(rounds):
        for k, (n, _inertia, sums) in cluster_sums(blocks, centroids).items():
            centroids[k] = [s // n for s in sums]
    last = {k: v[1] for k, v in cluster_sums(blocks, centroids).items()}
    inertia, texts = sum(last.values()), [text_of(c) for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, low, high, _ = _row_vectors(row)
                able = candidates(low, high, centroids)
                choice, distance = nearest(x, centroids[able])
                cluster = able[choice]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(distance),
                     pa.array([last[k] for k in cluster.tolist()], pa.int64()), pa.array(np.full(len(x), inertia)),
                     pa.array([texts[k] for k in cluster.tolist()], pa.string())],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, schema)


def clustered_sql(count: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """The same rows in SQL, one step of the rounds after the other."""
    parts = [f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INT AS k, v AS c
  FROM (SELECT vec_id, v FROM kept ORDER BY sha256('{seed}:' || vec_id) LIMIT {count})
)"""]
    for i in range(rounds + 1):
        parts.append(f""", a{i} AS MATERIALIZED (
  SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, k := k)) AS best
  FROM kept CROSS JOIN c{i} GROUP BY vec_id, v
)""")
        if i < rounds:
            parts.append(f""", m{i} AS MATERIALIZED (
  SELECT k, list(floor(total / n)::BIGINT ORDER BY place) AS c FROM (
    SELECT best.k AS k, place, sum(v[place])::DOUBLE AS total, count(*)::DOUBLE AS n
    FROM a{i}, generate_series(1, {DIMS}) AS g(place) GROUP BY 1, 2) GROUP BY k
), c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))""")
    last = rounds
    parts.append(f"""
SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON best.k = k""")
    return "".join(parts)


CLUSTERED_SQL = clustered_sql()
