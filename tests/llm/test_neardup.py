"""Near-duplicates against brute force."""

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpivane.llm import neardup, queries
from kpivane.llm.graph import components
from tests.support import DATA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    return set(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    holders, shared = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[ids[b], ids[a]] += 1
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(frame):
    rows = frame.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_query_against_brute_force(spark):
    path = f"{DATA}/sf0.01"
    docs = [(r.doc_id, r.text) for r in queries.table(spark, path, "documents").collect()]
    assert found(queries.op2_minhash_near_dedup(spark, path)) == brute(docs)


def test_a_crowd_of_near_copies_and_a_shared_passage(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 32)
    rng = random.Random(1)
    base, passage = [f"w{i}" for i in range(90)], [f"p{i}" for i in range(60)]
    docs = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, " ".join([*passage, *[f"y{i}_{j}" for j in range(20 + i % 30)]])) for i in range(80)]
    got = found(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == brute(docs)


def test_nulls_short_texts_repeats_and_other_columns(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "Two Words"), (5, "two\twords"), (6, "words two"), (7, "a b c d e"), (8, "A B C D E"), (8, "A B C D E"), (None, "a b c d e")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("bands", F.lit("clash")).withColumn("component_id", F.lit(0))
    result = neardup.near_duplicates(frame)
    got = found(result)
    assert result.columns == ["doc_id", "n_shingles", "component_id", "kept"] and result.count() == len(docs)
    assert [got[i] for i in range(1, 9)] == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 4), (1, 6), (1, 7), (1, 7)]
    kept = neardup.without_duplicates(frame)
    assert kept.columns == frame.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    label = {i: i for p in pairs for i in p}
    for _ in range(40):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    edges = spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {i: c for i, c in label.items() if i != c}
