"""Grammar-compressed token files."""

import zlib
from collections import Counter
from itertools import pairwise
from uuid import uuid4

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kpivane.llm import grammar, queries
from kpivane.llm.tokens import encoder
from kpivane.sources.stage import stage_root
from tests.support import DATA

FILE = queries.tokenizer_file()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=12))
def test_round_trip_and_random_access(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    packed = grammar.compress(ids, bounds)
    assert grammar.expand(packed["sequence"], packed["rules"], packed["rule_lengths"]).tolist() == ids.tolist()
    row = {"doc_places": packed["places"].astype("<u4").tobytes(), "rules": packed["rules"].astype("<u4").tobytes(),
           "rule_lengths": packed["rule_lengths"].tobytes(), "sequence": packed["sequence"].tobytes()}
    for nth, doc in enumerate(docs):
        assert grammar.document_ids(row, nth).tolist() == doc


def test_repeats_are_compressed():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    packed = grammar.compress(ids, np.array([0, len(ids)]))
    assert len(packed["sequence"]) * 8 < len(ids) and (packed["rule_lengths"] >= 2).all()


def test_rules_are_expanded_once_where_they_are_fewer_than_the_ids(monkeypatch):
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.2, 50_000) % 3_000).astype(np.uint32)
    packed = grammar.compress(ids, np.array([0, len(ids)]))
    assert packed["rule_lengths"].sum() < len(ids)
    seen, by_levels = [], grammar._by_levels
    monkeypatch.setattr(grammar, "_by_levels", lambda seq, rules: seen.append(len(seq)) or by_levels(seq, rules))
    assert np.array_equal(grammar.expand(packed["sequence"], packed["rules"], packed["rule_lengths"]), ids)
    assert seen == [2 * len(packed["rules"])]
    some = packed["sequence"][:3]
    assert np.array_equal(grammar.expand(some, packed["rules"], packed["rule_lengths"]), ids[: len(grammar._by_levels(some, packed["rules"]))])


def test_no_pair_is_left_that_repeats_enough():
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 1 << 16, 2_000)
    ids = np.concatenate([np.tile(passage, 200), rng.zipf(1.3, 60_000) % 30_000]).astype(np.uint32)
    bounds = np.array([*range(0, 400_001, 2_000), 430_000, 460_000])
    packed = grammar.compress(ids, bounds)
    ends = packed["places"].astype(int)
    assert ends[200] == 200 and (packed["rule_lengths"] == 2_000).any()
    pairs = Counter(p for a, b in zip(ends[:-1], ends[1:], strict=True) for p in pairwise(packed["sequence"][a:b].tolist()))
    assert max(pairs.values()) < grammar.LEAST
    assert np.array_equal(grammar.expand(packed["sequence"], packed["rules"], packed["rule_lengths"]), ids)


def test_query_against_the_tokenizer(spark):
    path = f"{DATA}/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op8_token_files(spark, path).collect()}
    start, wanted = 0, {}
    for r in queries.table(spark, path, "documents").orderBy("doc_id").collect():
        ids = np.array(encoder(FILE).tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], np.uint32)
        wanted[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == wanted


def written(spark, docs):
    path = f"{stage_root(spark)}/ids-{uuid4().hex}"
    grammar.write_ids(docs, path, FILE, 2)
    return grammar.read_ids(spark, path)


def test_nulls_repeats_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(grammar, "BLOCK_IDS", 64)
    rows = [(3, "word " * 500, 1), (3, "word " * 500, 1), (None, "a b", 2), (1, None, 3), (2, "", 4), *[(10 + i, f"text {i}", i) for i in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start int")
    got = sorted(written(spark, docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][:5] == [None, 1, 2, 3, 3] and len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at and len(r.tokens) == 4 * r.n_tokens and bytes(r.tokens)[-4:] == b"\2\0\0\0"
        at += r.n_tokens
    assert written(spark, docs.limit(0)).count() == 0
