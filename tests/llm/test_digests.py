"""Fingerprints against plain entropies, filters and pairings."""

import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpivane.llm import digests, queries
from tests.support import DATA

DOCS = "doc_id bigint, text string"
FLAT = np.arange(digests.LEVELS + 1)


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(words))


def plain_features(data, ranks):
    """Feature positions, one window after the other."""
    w, near = digests.WINDOW, digests.NEIGHBOURS
    rank = []
    for i in range(len(data) - w + 1):
        counts = Counter(data[i : i + w]).values()
        h = -sum(c / w * math.log2(c / w) for c in counts)
        rank.append(int(ranks[min(digests.LEVELS, int(h * digests.LEVELS / math.log2(w) + 1e-3))]))
    points = Counter()
    if 0 < len(rank) < near:
        best = min(range(len(rank)), key=lambda i: (rank[i], i))
        points[best] = digests.POPULAR if rank[best] < digests.WEAK else 0
    for j in range(len(rank) - near + 1):
        best = min(range(j, j + near), key=lambda i: (rank[i], i))
        points[best] += rank[best] < digests.WEAK
    chosen = sorted(i for i, n in points.items() if n >= digests.POPULAR)
    most = max(points.values(), default=0)
    return chosen or ([min(i for i, n in points.items() if n == most)] if most else [])


def test_features_equal_plain_ones():
    rng = random.Random(2)
    texts = [prose(rng, n).encode() for n in (1, 3, 4, 8, 40, 400)] + [b"", b"a" * 300, b"ab" * 9, "é日本".encode() * 30, prose(rng, 90).encode() * 3]
    ranks = digests.rank_table(dict(enumerate(np.random.default_rng(1).integers(0, 50, digests.LEVELS + 1).tolist())))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = digests.chosen_windows(data, bounds, ranks)
    want = [int(b) + i for t, b in zip(texts, bounds, strict=False) for i in plain_features(t, ranks)]
    # An entropy at the edge of two levels may fall on either side in floating point.
    assert len(set(got.tolist()) ^ set(want)) <= 0.02 * len(want)
    digests_chunked, whole = digests.CHUNK, got
    try:
        digests.CHUNK = 100
        assert digests.chosen_windows(data, bounds, ranks).tolist() == whole.tolist()
    finally:
        digests.CHUNK = digests_chunked


def test_filters_hold_their_features_and_chain():
    rng = random.Random(3)
    long, short = prose(rng, 4_000), prose(rng, 60)
    big, small, none, one = digests.digests([long.encode(), short.encode(), b"", b"word"], FLAT)
    assert len(big.filters) == -(-int(big.counts.sum()) // digests.FEATURES) and len(small.filters) == 1
    assert (big.counts[:-1] == digests.FEATURES).all() and len(none.filters) == 0 and one.counts.tolist() == [1]
    assert int(np.bitwise_count(one.filters).sum()) <= digests.HASHES
    n, data = big.text().split(".")[0].split(":")
    assert int(n) == digests.FEATURES and base64.b64decode(data) == big.filters[0].tobytes()
    assert digests.likeness(none, none) == 1.0 == digests.likeness(big, big) and digests.likeness(none, big) == 0.0
    assert digests.likeness(one, big) < 0.1 and digests.likeness(small, big) == digests.likeness(big, small) < 0.1
    part, = digests.digests([long[: len(long) * 3 // 4].encode()], FLAT)
    assert 0.6 < digests.likeness(part, big) < 1.0


def check(rows, docs):
    """Every column that can be told from the texts alone; the order of equal ids is taken from the result's own pairs."""
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for (number, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        row, changed = by_id[number], digests.edited(text or "", following or "")
        assert row.n_chars == len(text or "")
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0.0 <= row.near_edited <= 1.0 and 0.0 <= row.near_next <= 1.0
        assert (row.fingerprint == row.edited_fingerprint) <= (row.near_edited == 1.0)
    prints = {}
    for number, text in docs:
        assert prints.setdefault(text or "", by_id[number].fingerprint) == by_id[number].fingerprint


@pytest.mark.parametrize("bucket_rows", [4, 4096])
def test_query_pairs_all_documents(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(digests, "BUCKET_ROWS", bucket_rows)
    path = f"{DATA}/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    rows = queries.QUERIES["op12_fingerprints"](spark, path).collect()
    check(rows, docs)
    near = sorted(r.near_edited for r in rows)
    assert near[len(near) // 20] > 0.3 and sum(r.near_next > 0.2 for r in rows) < 0.1 * len(rows)


def test_odd_texts(spark):
    rng = random.Random(4)
    docs = [(None, prose(rng, 50)), (1, None), (2, ""), (3, "x"), (4, prose(rng, 30_000)), (-7, "日本語" * 50), (9, "aaaa" * 900), (12, prose(rng, 5))]
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("bucket", "tie", "guest", "_at", "n_chars")}).repartition(3)
    check(digests.fingerprints(frame).collect(), docs)
    twice = spark.createDataFrame([(1, "abc " * 30), (1, "abc " * 30), (1, "other text " * 20), (2, "end of it all")], DOCS)
    assert digests.fingerprints(twice).count() == 4
    assert digests.fingerprints(frame.where("doc_id > 100")).count() == 0
    alone, = digests.fingerprints(spark.createDataFrame([(5, "only one document here")], DOCS)).collect()
    assert alone.edited_sha256 == hashlib.sha256(digests.edited("only one document here", "only one document here").encode()).hexdigest()
    assert alone.near_next == 1.0
