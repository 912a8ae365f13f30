"""Spelling variants: words one code point apart, found by PartEnum signatures of their letter multisets.

A word is the set of its letters with their occurrence numbers (the second `e` is another element than the
first), a binary vector. One replaced code point changes two elements, an inserted or deleted one changes
one. Elements are dealt into PARTS parts. Two sets of Hamming distance two agree in all but two parts, so
they share the signature of some choice of parts to leave out, two for words of one length and one for
words whose lengths differ by one. Words meet in an equi-join on signatures and are verified there; no
near pair can be missed, whatever the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import settled
from .words import mixed, odd_numbers, slices

# What stands between words once A-Z are lower-cased, and how rarely a letter is deleted.
BETWEEN = "[^a-zÀ-ÿ]+"
DROPPED = 199

PARTS = 6
CROWD = 256
SLICE_BYTES = 8 << 20


def _slice_counts(numbers: list, texts: pa.Array, least_length: int) -> pa.RecordBatch:
    """`word, n` of some texts, each word once or twice."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    flat = lists.flatten()
    kept = pc.greater_equal(pc.utf8_length(flat), least_length)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = flat.filter(kept).dictionary_encode()
    size = max(1, len(coded.dictionary))
    # One row for each document and word: all occurrences share a hash.
    pairs, times = np.unique(owner[kept.to_numpy(zero_copy_only=False)] * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    docs, codes = np.divmod(pairs, size)
    begun = [crc32(f"{'' if i is None else i}:".encode()) for i in numbers]
    raw = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter((crc32(raw[c], begun[d]) for d, c in zip(docs.tolist(), codes.tolist(), strict=True)), np.int64, len(pairs))
    hit = hashes % DROPPED == 0
    n = np.bincount(codes[~hit], times[~hit], len(coded.dictionary)).astype(np.int64)
    seen = pa.array(n > 0)
    words, counts = coded.dictionary.filter(seen).to_pylist(), n[n > 0].tolist()
    for code, h, many in zip(codes[hit].tolist(), hashes[hit].tolist(), times[hit].tolist(), strict=True):
        word = raw[code].decode()
        at = h % len(word)
        if len(word) > least_length:
            words.append(word[:at] + word[at + 1 :])
            counts.append(many)
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """`word, n`: the words of at least `least_length` code points that occur at least `least_count` times.

    Words are the runs of letters of the texts, A-Z lower-cased; where DROPPED divides the crc32 of
    `<doc_id>:<run>`, the run's letter at that number modulo its length is deleted. A null text has no
    runs; a null doc_id counts as the empty text in the hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                yield _slice_counts(batch.column("doc_id").to_pylist(), batch.column("text"), least_length)

    counts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def part_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x PARTS) exclusive or of the hashes of each word's elements, by the part they are dealt to; and the lengths."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), lengths)
    ordered = np.sort(owner << np.uint64(32) | letters)
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    place = np.arange(len(ordered))
    nth = place - np.maximum.accumulate(np.where(begins, place, 0))
    factors = odd_numbers(41_011, 2)
    element = mixed((ordered & np.uint64(0xFFFFFFFF)) * factors[0] + nth.astype(np.uint64) * factors[1])
    out = np.zeros((len(words), PARTS), np.uint64)
    np.bitwise_xor.at(out, ((ordered >> np.uint64(32)).astype(np.int64), (element % np.uint64(PARTS)).astype(np.int64)), element)
    return out, lengths


def signatures(words: DataFrame) -> DataFrame:
    """`word, side, length, key`: all signatures of the distinct words; `key` is a hash, since pairs are verified.

    Each leaves other parts out. `side` is 0 for words of one length, which join with each other, and 1 for
    the shorter, 2 for the longer word of lengths that differ by one; `length` is the shorter one.
    """
    left_out = [(0, pair) for pair in combinations(range(PARTS), 2)] + [(side, (p,)) for p in range(PARTS) for side in (1, 2)]
    salts = dict(zip(dict.fromkeys(pair for _, pair in left_out), odd_numbers(41_012, len(left_out)), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, lengths = part_hashes(batch.column("word"))
            every = np.bitwise_xor.reduce(parts, axis=1)
            for side, pair in left_out:
                shorter = lengths - (side == 2)
                value = every ^ np.bitwise_xor.reduce(parts[:, list(pair)], axis=1)
                key = mixed(value + salts[pair] * (shorter.astype(np.uint64) + np.uint64(1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("word"), pa.array(np.full(len(key), side, np.int8)), pa.array(shorter.astype(np.int32)), pa.array(key.view(np.int64))],
                    names=["word", "side", "length", "key"])

    return words.select("word").mapInArrow(run, "word string, side tinyint, length int, key bigint")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """`word, near`, both ways and once each: the pairs of distinct words that differ by exactly one code point.

    Buckets of more than `crowd` words (anagrams, mostly) are cut further, exactly: words one edit apart
    share the first or the last half of the shorter one. Pairs are verified inside the join, so a bucket
    gives only its near pairs; a pair that meets in several buckets is counted once.
    """
    signed = settled(signatures(words))
    crowded = settled(signed.groupBy("key").agg(F.count("*").alias("_m")).where(F.col("_m") > crowd).select("key", F.lit(True).alias("_crowded")))
    half = F.floor(F.col("length") / 2).cast("int")
    halves = F.array(F.substring("word", 1, half), F.reverse(F.substring(F.col("word"), F.length("word") - F.col("length") + half + 1, F.col("length"))))
    joined = signed.join(crowded, "key", "left")
    cut = joined.select("word", "side", "key", F.posexplode(F.when(F.col("_crowded"), halves).otherwise(F.array(F.lit("")))).alias("end", "half"))
    placed = cut.select("word", "side", F.when(F.col("half") == "", F.col("key")).otherwise(F.xxhash64("key", "end", "half")).alias("key"))
    left, right = placed.where("side < 2").alias("a"), placed.where("side <> 1").alias("b")
    # The two sides: words of one length in one order, the shorter with the longer.
    fitting = F.when(F.col("a.side") == 0, (F.col("b.side") == 0) & (F.col("a.word") < F.col("b.word"))).otherwise(F.col("b.side") == 2)
    on = (F.col("a.key") == F.col("b.key")) & fitting & (F.levenshtein("a.word", "b.word", 1) == 1)
    pairs = settled(left.join(right, on).select(F.col("a.word").alias("word"), F.col("b.word").alias("near")).distinct())
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def follow(forms: DataFrame) -> DataFrame:
    """`word, root`: where the chain word -> form ends. Each round doubles the steps that every row has gone."""
    now = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        further = now.join(ahead, F.col("root") == F.col("_at"), "left")
        if further.where("_root is not null").isEmpty():
            return now
        now = settled(further.select("word", F.coalesce("_root", "root").alias("root")))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """One row per row of `words` (word, n; words are distinct): word, form, root, n, n_near and form_n.

    A word's form is its most frequent near word (ties: the first in code-point order) if it is at least
    `ratio` times as frequent as the word, and null otherwise. Forms are more frequent than their words, so
    chains end; the root is the end, or the word itself. A null word or n gives no row, no rows give no rows.
    """
    known = settled(words.select(F.col("word").cast("string"), F.col("n").cast("bigint")).where("word is not null and n is not null"))
    counts = known.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # The smallest of (-n, word): the most frequent, then the first.
    best = near_words(known.select("word")).join(counts, "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    joined = known.join(best, "word", "left")
    fits = -F.col("best.least") >= F.lit(ratio) * F.col("n")
    rows = settled(joined.select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, -F.col("best.least")).alias("form_n")))
    roots = follow(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the frequent words of all documents (doc_id, text); other columns are ignored.

    Texts may be null or empty (no words) or of any length; a repeated row counts again.
    """
    return variants(frequent_words(docs))
