"""Zone-mapped clusters against plain numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpivane.llm import centroids

VECTORS = "vec_id bigint, embedding array<float>"


def brute(rows, count=40, rounds=5):
    kept = [(i, np.floor(256 * np.asarray(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in rows]
    starts = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)[:count]
    at = [np.array(v) for _, v in starts]
    x = np.array([v for _, v in kept])

    def assign():
        apart = np.stack([((x - c) ** 2).sum(axis=1) for c in at], axis=1)
        return apart.argmin(axis=1), apart.min(axis=1)

    for _ in range(rounds):
        choice, _ = assign()
        at = [np.array([int(s) // int((choice == k).sum()) for s in x[choice == k].sum(axis=0)]) if (choice == k).any() else c
              for k, c in enumerate(at)]
    choice, apart = assign()
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    inertia = [int(apart[choice == k].sum()) for k in range(len(at))]
    return sorted((str(i), int(k), int(d), int(inertia[k]), int(apart.sum()), names[k]) for (i, _), k, d in zip(kept, choice, apart, strict=True))


def got(frame):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect())


def test_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
        place = centroids.hilbert_index(grid, bits)
        ordered = grid[np.argsort(place)]
        assert sorted(place.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest():
    rng = np.random.default_rng(3)
    ruled_out = 0
    for spread in (1, 20, 200):
        at = rng.integers(-300, 300, (20, 64))
        x = at[rng.integers(0, 20, 50)] + rng.integers(-spread, spread + 1, (50, 64))
        for box in (x, x[:1], x[:5]):
            able = centroids.candidates(box.min(axis=0), box.max(axis=0), at)
            assert set(centroids.nearest(box, at)[0].tolist()) <= set(able.tolist())
            ruled_out += 20 - len(able)
    assert ruled_out > 0


@pytest.mark.parametrize("scale", [1.0, 30_000.0])
def test_equals_brute_force(spark, scale):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(6, 64))
    rows = [(i, (scale * (middles[i % 6] + 0.2 * rng.normal(size=64))).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1_000 + i, [0.5] * 64) for i in range(300)] + [(None, [0.25] * 64), (5, [0.125] * 64)]
    bad = [(2_000, None), (2_001, [1.0] * 63), (2_002, [1.0] * 65), (2_003, [None] + [1.0] * 63), (2_004, [float("nan")] + [1.0] * 63),
           (2_005, [float("inf")] + [1.0] * 63), (2_006, [1e30] + [0.0] * 63), (2_007, [])]
    frame = spark.createDataFrame(rows + bad, VECTORS).repartition(3)
    assert got(centroids.clustered(frame)) == brute(rows)
    kept = centroids.whole_vectors(frame)
    blocks = centroids.zone_blocks(kept, 64)
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == len(rows)
    if scale == 1.0:
        able = centroids.candidate_counts(blocks, np.floor(256 * middles).astype(np.int64)).agg(F.avg("n_candidates")).first()[0]
        assert able < 5


def test_few_vectors_clashing_columns_and_no_rows(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)] + [(9, [1.0] * 64)] * 2
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"cluster": F.lit("x"), "data": F.lit(1), "place": F.lit(2), "ids": F.lit(3)})
    assert got(centroids.clustered(frame)) == brute(rows)
    assert got(centroids.clustered(frame.where("vec_id < 0"))) == []
    assert got(centroids.clustered(spark.createDataFrame([(None, [1.0] * 64)], VECTORS))) == []
