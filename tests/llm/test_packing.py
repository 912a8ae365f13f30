"""Token pieces and best-fit packing."""

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpivane.llm import packing, queries
from kpivane.llm.tokens import encoder
from kpivane.sources.stage import settled
from tests.support import DATA

FILE = queries.tokenizer_file()
ODD = ["<|ENDOFTEXT|> x", "<|endoftext|>", "a<|startoftext|>b, c.", "don't, it's. 'tis", "H̱ É, İstanbul. ΣΣ", " x y", "...,",
       "a., b,. 1.", "", None, "\x1c a\x1fb \x85", "ﬁ Ǆ,", " ́a", "A" * 5000, "x, " * 3000]


def reference(text, end):
    return np.array(encoder(FILE).tokenizer.encode(text or "", add_special_tokens=False).ids + [end], np.uint32)


def test_words_give_the_ids_of_the_whole_text():
    ids, bounds = encoder(FILE).encode(pa.array(ODD))
    for i, text in enumerate(ODD):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == reference(text, 0)[:-1].tolist()


class Task:
    """Stands for a table and hands out the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_a_task_holds_a_bounded_part_of_its_batch(spark):
    texts = ["the cat and a dog of the house, " * 500] * 600
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], names=["doc_id", "text"])
    run = packing.token_pieces(Task(), FILE, 4096, 1)
    encoder(FILE).encode(pa.array(texts[:1]))
    tracemalloc.start()
    try:
        pieces = sum(part.num_rows for part in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pieces == 600 * -(-len(reference(texts[0], 1)) // 4096)
    assert peak < 48 << 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_words_give_the_ids_of_any_text(texts):
    ids, bounds = encoder(FILE).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == reference(text, 0)[:-1].tolist()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=15))
def test_plan_uses_every_piece_within_capacity(counts):
    used, bins = defaultdict(int), 0
    for pattern, times in packing.minimum_bin_slack(counts, 50):
        assert sum(n * m for n, m in pattern) <= 50 and times > 0
        bins += times
        for n, m in pattern:
            used[n] += m * times
    assert dict(used) == counts
    total = sum(n * c for n, c in counts.items())
    assert -(-total // 50) <= bins <= max(1, 2 * total // 50 + 1) or not counts


def test_fullest_is_the_best_subset():
    lengths, counts = [31, 17, 9, 4], {31: 1, 17: 2, 9: 1, 4: 3}
    for room in range(80):
        sums = {a * 31 + b * 17 + c * 9 + d * 4 for a in range(2) for b in range(3) for c in range(2) for d in range(4)}
        got = packing.fullest(lengths, counts, room)
        assert sum(n * m for n, m in got) == max(s for s in sums if s <= room) and all(m <= counts[n] for n, m in got)


def test_a_bad_length_is_refused():
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({0: 1}, 10)
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({11: 1}, 10)


def gapless(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query_against_the_tokenizer(spark):
    path = f"{DATA}/sf0.001"
    rows = queries.op1_best_fit_packing(spark, path).collect()
    wanted = {}
    for r in queries.table(spark, path, "documents").collect():
        ids = reference(r.text, 1)
        for k in range(0, len(ids), 4096):
            wanted[r.doc_id, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == wanted and len(rows) == len(wanted)
    assert gapless(rows, 4096) == -(-sum(r.length for r in rows) // 4096)


def test_nulls_repeats_long_texts_and_other_columns(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "y"), (None, "some words", "z"), (3, "word " * 900, "a"), (3, "word " * 900, "a"), (4, "tie", "b"), (5, "tie", "c")],
        "doc_id bigint, text string, tokens string").withColumn("length", F.lit("clash"))
    pieces = settled(packing.token_pieces(docs, FILE, 64, 1))
    assert {r.doc_id: bytes(r.tokens) for r in pieces.where("doc_id in (1, 2)").collect()} == {1: b"\1\0\0\0", 2: b"\1\0\0\0"}
    packed = packing.best_fit(pieces.withColumn("offset", F.lit("old")), 64)
    rows = packed.collect()
    assert packed.columns == ["doc_id", "piece", "start", "length", "tokens", "sequence_id", "offset"]
    assert sum(r.doc_id == 3 for r in rows) == 2 * -(-901 // 64) and any(r.doc_id is None for r in rows)
    gapless(rows, 64)
    assert packing.best_fit(settled(pieces.limit(0)), 64).count() == 0


def test_a_hot_length_is_ranked_in_blocks(spark):
    pieces = settled(spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 60 + 1).cast("bigint").alias("length")))
    rows = packing.best_fit(pieces, 64).collect()
    assert len(rows) == 30_000
    assert gapless(rows, 64) <= 1.02 * sum(r.length for r in rows) / 64
