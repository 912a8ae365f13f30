"""Binary code search and vector near-duplicates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpivane.llm import hamming, queries, vectors
from tests.support import DATA, differences, duck


def test_top_k_against_sql(spark):
    path = f"{DATA}/sf0.01"
    assert differences(queries.op5_exact_top_k(spark, path), duck(path), queries.SQL["op5_exact_top_k"]) is None


def test_top_k_with_copies_ties_and_nulls(spark):
    rng = np.random.default_rng(4)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(1 << 62), 1 << 62, 40))]
    codes += [(100 + i, codes[0][1]) for i in range(300)] + [(7, codes[7][1]), (None, 5), (500, None)]
    frame = spark.createDataFrame(codes, "vec_id bigint, code bigint").withColumn("distance", F.lit("clash"))
    got = {}
    for r in hamming.top_k(frame, frame.where("vec_id in (0, 7, 120)"), 4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    known = {i: c for i, c in codes if i is not None and c is not None}
    for q in (0, 7, 120):
        near = sorted((bin((known[q] ^ c) & (1 << 64) - 1).count("1"), i) for i, c in known.items() if i != q)[:4]
        assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(near)]
    assert hamming.top_k(frame.limit(0), frame, 4).count() == 0
    assert hamming.top_k(frame, frame.limit(0), 4).count() == 0
    few = spark.createDataFrame([(1, 0), (2, 1)], "vec_id bigint, code bigint")
    assert [(r.query_id, r.vec_id) for r in hamming.top_k(few, few.where("vec_id = 1"), 4).collect()] == [(1, 2)]


def test_codes_of_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, [1.0, -1.0] * 32), (7, [1.0] + [0.0] * 63 + [-2.0])]
    got = {r.vec_id: r.code for r in spark.createDataFrame(rows, "vec_id bigint, v array<float>").select("vec_id", hamming.sign_code("v").alias("code")).collect()}
    assert [got[i] for i in range(1, 6)] == [None] * 5 and bin(got[6] & (1 << 64) - 1).count("1") == 32 and got[7] == 0


def brute(rows, cosine):
    good = [(i, np.array(v, np.float32).astype(float), k) for i, v, k in rows
            if i is not None and v and k is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    n, root = {}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        i, x, k = good[a]
        n[i] = 0
        for b, (j, y, m) in enumerate(good):
            if a != b and k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                n[i] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (n.get(i, 0), find(i)) for i, _, _ in rows}


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        if i % 3 == 0:
            v = rng.normal(size=64)
        else:
            v = np.where(np.arange(64) % 2 == i % 2, 1.0, -0.5) + rng.normal(0, 0.25 if i % 5 else 0.0, 64)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 4 if i % 17 else None))
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 64, 1), (403, [float("nan")] * 64, 1), (404, [None] * 64, 1), (405, [1.0] * 12, 1), (406, [1.0] * 12, 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("keys", F.lit("clash")).withColumn("id", F.lit(1))
    result = vectors.near_vectors(frame)
    got = {r.vec_id: (r.n_links, r.component_id) for r in result.collect()}
    wanted = brute(rows, 0.93)
    links = sum(n for n, _ in wanted.values())
    assert links > 100 and sum(n for n, _ in got.values()) >= 0.99 * links and all(got[i][0] <= wanted[i][0] for i in got)
    assert sum(got[i] == wanted[i] for i in wanted) >= 0.98 * len(wanted) and result.count() == len(rows)
    assert all(got[i] == (0, i) for i in range(400, 405)) and got[406] == (1, 405)
    assert vectors.near_vectors(frame.limit(0)).count() == 0
    labels = frame.withColumn("label", F.col("label").cast("string"))
    assert vectors.near_vectors(labels).count() == len(rows)


def test_null_ids_and_repeated_rows(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (3, [1.0, 2.0], 2)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def test_the_query_finds_the_links(spark):
    path = f"{DATA}/sf0.1"
    rows = [(r.vec_id, r.embedding, r.label) for r in queries.table(spark, path, "embeddings").collect()]
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    links = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in queries.op7_vector_near_dedup(spark, path).collect()}
    assert all(got[i] <= n for i, n in zip(ids, links, strict=True)) and sum(got.values()) >= 0.9 * links.sum()


@pytest.mark.parametrize("width", [8, 16])
@pytest.mark.parametrize("common", [0.0, 0.5, 0.8])
def test_a_shared_direction_loses_no_links(common, width):
    """Vectors whose mean cosine is `common`; both kinds of width."""
    rng = np.random.default_rng(3)
    x = np.sqrt(1 - common) * rng.normal(size=(4_000, 64)) / 8 + np.sqrt(common) * np.eye(64)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    across = rng.normal(size=x.shape)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * across / np.linalg.norm(across, axis=1, keepdims=True)
    own = vectors.matrices_for(x, 64, width, 0.93)
    missed = (vectors.table_keys(x, own, width) != vectors.table_keys(y, own, width)).all(axis=1)
    assert missed.mean() <= 3 * vectors.MISSED


def test_links_of_vectors_with_a_shared_direction(spark):
    rng = np.random.default_rng(6)
    base = 0.45 * rng.normal(size=(400, 64)) / 8 + 0.9 * np.eye(64)[0]
    x = np.concatenate([base, base + 0.33 * rng.normal(size=base.shape) / 8])
    rows = [(i, [float(c) for c in v.astype(np.float32)], i % 2) for i, v in enumerate(x)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    wanted = sum(n for n, _ in brute(rows, 0.93).values())
    assert wanted > 100 and sum(r.n_links for r in got) >= 0.998 * wanted
