"""Spelling variants against brute force."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from kpivane.llm import queries, spelling
from tests.support import DATA

DOCS = "doc_id bigint, text string"
PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    seen = Counter()
    for number, text in docs:
        for raw in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = raw.translate(PLAIN)
            h = crc32(f"{'' if number is None else number}:{run}".encode())
            at = h % len(run)
            seen[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return seen


def near(words):
    """Each word's near words: those that share a gap pattern (one letter replaced, or put in)."""
    found, by_gap = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i] + "*" + w[i + 1 :]].add(w)
    for group in by_gap.values():
        for w in group:
            found[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                found[w].add(shorter)
                found[shorter].add(w)
    return found


def expected(counts):
    links, form = near(counts), {}
    for w, n in counts.items():
        best = min(links[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(links[w]), counts.get(form[w])) for w, n in counts.items())


def got(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark):
    path = f"{DATA}/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    counts = {w: n for w, n in counted(docs).items() if len(w) >= 6 and n >= 5}
    rows = got(queries.QUERIES["op11_spelling_variants"](spark, path))
    assert rows == expected(counts) and any(r[1] for r in rows)


@pytest.mark.parametrize("crowd", [1, 256])
def test_random_words_anagrams_and_chains(spark, crowd):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(300)}
    words |= {"".join(rng.sample("abcdefg", 7)) for _ in range(300)} | {"colour", "color", "colou", "colourx", "aaaaaa", "aaaaaaa"}
    links = {(r.word, r.near) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), crowd).collect()}
    assert links == {(a, b) for a, others in near(words).items() for b in others}
    counts = {w: rng.choice([5, 6, 30, 31, 160, 900]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got(spelling.variants(frame)) == expected(counts)


def test_words_of_odd_texts(spark):
    docs = [(1, None), (2, ""), (None, "Straße ÉTÉS Überall straße"), (3, "12 -- ?"), (4, "Abcdefg" * 30_000), (5, "x" * 5 + " " + "Zebras " * 7),
            (5, "Zebras " * 7), (6, "日本語 abcdéf×÷ý")] + [(i, "harvest harvests HARVEST") for i in range(100, 3_000)]
    rows = {r.word: r.n for r in spelling.frequent_words(spark.createDataFrame(docs, DOCS), 6, 1).collect()}
    assert rows == {w: n for w, n in counted(docs).items() if len(w) >= 6}
    assert len([w for w in rows if w in {"arvest", "hrvest", "havest", "harest", "harvst", "harvet", "harves"}]) > 0


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "meadow meadow meadow meadow meadow", "w", 3)], "doc_id bigint, text string, word string, n int").withColumn("key", F.lit(1))
    assert got(spelling.spelling_variants(docs)) == [("meadow", None, "meadow", 5, 0, None)]
    assert got(spelling.spelling_variants(docs.where("doc_id < 0"))) == []
    assert got(spelling.variants(spark.createDataFrame([(None, 3), ("meadow", None)], "word string, n bigint"))) == []
