"""Document fingerprints: improbable features in chained Bloom filters, compared by normalised bit overlap.

Every window of WINDOW bytes has an entropy. How often each entropy (in LEVELS steps) occurs in all
documents ranks it: the rarer, the lower. In every neighbourhood of NEIGHBOURS windows the first one of the
lowest rank gets a point, and windows with POPULAR points are the document's features. Each feature sets
five bits of a filter of 2,048 bits; a filter takes FEATURES of them, then the next one begins.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mixed, odd_numbers, slices

WINDOW, NEIGHBOURS, POPULAR = 16, 32, 8
LEVELS = 1000
#: Windows of less entropy (of LEVELS), such as runs of one byte, are never features.
LEAST_ENTROPY = 100
BITS, HASHES, FEATURES = 2048, 5, 160
#: Overlap that counts as chance, as a share of the way from the expected to the greatest overlap.
MARGIN = 0.3
CHUNK = 1 << 17
SLICE_BYTES = 2 << 20
BUCKET_ROWS, MOST_BUCKETS = 4096, 20_000

WEAK = LEVELS + 1
#: LEVELS steps of c * log2(c), in 2 ** -20 parts, for a count of c equal bytes.
_PARTS = np.round(np.arange(WINDOW + 1) * np.log2(np.maximum(np.arange(WINDOW + 1), 1)) * (1 << 20)).astype(np.int64)
_STEP = np.diff(_PARTS, prepend=0)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of each window of a byte array, from 0 to LEVELS (the greatest that WINDOW bytes can have)."""
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int16)
    ahead, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = data[lag:] == data[:-lag]
        ahead[:-lag] += same
        behind[lag:] += same
    # From one window to the next a byte leaves and one comes: only their own counts change.
    first = int(_PARTS[np.bincount(data[:WINDOW])].sum())
    change = _STEP[1 + behind[WINDOW:].astype(np.int64)] - _STEP[1 + ahead[: n - 1].astype(np.int64)]
    held = first + np.concatenate([[0], np.cumsum(change)])
    most = np.log2(WINDOW)
    return np.clip((most - held / (WINDOW * float(1 << 20))) * (LEVELS / most), 0, LEVELS).astype(np.int16)


def _inside(bounds: np.ndarray, width: int, total: int) -> np.ndarray:
    """True where a run of `width` positions from here stays inside one document."""
    crossing = np.zeros(total + 1, np.int32)
    ends = bounds[1:]
    begins = np.maximum(ends - width + 1, bounds[:-1])
    np.add.at(crossing, begins, 1)
    np.add.at(crossing, ends, -1)
    return np.cumsum(crossing)[:total] == 0


def window_levels(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Entropy levels of the windows that begin at each byte of some documents; -1 where a window would cross an end."""
    out = np.full(len(data), -1, np.int16)
    for begin in range(0, max(0, len(data) - WINDOW + 1), CHUNK):
        got = entropies(data[begin : begin + CHUNK + WINDOW - 1])
        out[begin : begin + len(got)] = got
    out[~_inside(bounds, WINDOW, len(data))] = -1
    return out


def rank_table(counts: dict[int, int]) -> np.ndarray:
    """Rank of each level by its number of windows in all documents, the rarest first; WEAK for those never chosen."""
    order = sorted(range(LEVELS + 1), key=lambda level: (counts.get(level, 0), level))
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    ranks[:LEAST_ENTROPY] = WEAK
    return ranks


def chosen_windows(data: np.ndarray, bounds: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Positions of the features of documents data[bounds[i]:bounds[i + 1]], ascending.

    A document of few windows is one neighbourhood. Where no window has POPULAR points the first of the
    most is taken; a document without any window to choose has none.
    """
    levels = window_levels(data, bounds)
    points = np.zeros(len(data), np.int32)
    span = WINDOW + NEIGHBOURS - 1
    whole = _inside(bounds, span, len(data))
    mask = (1 << 20) - 1
    for begin in range(0, len(data), CHUNK):
        part = levels[begin : begin + CHUNK + NEIGHBOURS - 1]
        low = np.where(part < 0, WEAK, ranks[part]) << 20 | np.arange(len(part))
        width = 1
        while width < NEIGHBOURS:
            low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
            width *= 2
        low = low[: CHUNK][whole[begin : begin + min(len(low), CHUNK)]]
        low = low[low >> 20 < WEAK] & mask
        points[begin : begin + len(part)] += np.bincount(low, minlength=len(part)).astype(np.int32)
    sizes = np.diff(bounds)
    for i in np.flatnonzero((sizes >= WINDOW) & (sizes < span)).tolist():
        part = levels[bounds[i] : bounds[i + 1] - WINDOW + 1]
        rank = ranks[part]
        best = int(rank.argmin())
        if rank[best] < WEAK:
            points[bounds[i] + best] = POPULAR
    chosen = points >= POPULAR
    some = np.concatenate([[0], np.cumsum(chosen)])
    for i in np.flatnonzero((some[bounds[1:]] == some[bounds[:-1]]) & (sizes >= WINDOW)).tolist():
        part = points[bounds[i] : bounds[i + 1]]
        best = int(part.argmax())
        chosen[bounds[i] + best] = part[best] > 0
    return np.flatnonzero(chosen)


class Digest(NamedTuple):
    """Chained filters of one document (filters x BITS / 64 words) and the features in each."""

    filters: np.ndarray
    counts: np.ndarray

    def text(self) -> str:
        """`features:filter` in base 64 for each filter, joined by dots; the empty text for an empty document."""
        return ".".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(self.counts.tolist(), self.filters, strict=True))


def digests(texts: list[bytes], ranks: np.ndarray) -> list[Digest]:
    """The digest of each text. A text without features has one, itself; an empty text has no filter."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = chosen_windows(data, bounds, ranks)
    words = np.stack([data[at + i] for i in range(WINDOW)], axis=1).view(np.uint64) if len(at) else np.zeros((0, WINDOW // 8), np.uint64)
    hashed = mixed((words * odd_numbers(71_003, WINDOW // 8)).sum(axis=1, dtype=np.uint64)) if len(at) else np.zeros(0, np.uint64)
    owner = np.searchsorted(bounds, at, side="right") - 1
    # The first place of each feature of a document, in the order of the text.
    order = np.lexsort((hashed, owner))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (hashed[order[1:]] == hashed[order[:-1]])
    owner, hashed = owner[~again], hashed[~again]
    alone = np.setdiff1d(np.flatnonzero(np.diff(bounds) > 0), owner)
    if len(alone):
        own = np.array([int.from_bytes(hashlib.sha256(texts[i]).digest()[:8], "little") for i in alone.tolist()], np.uint64)
        owner, hashed = np.concatenate([owner, alone]), np.concatenate([hashed, own])
        order = np.argsort(owner, kind="stable")
        owner, hashed = owner[order], hashed[order]
    begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    sizes = np.diff(begins)
    chain = -(-sizes // FEATURES)
    slots = np.concatenate([[0], np.cumsum(chain)])
    slot = slots[owner] + (np.arange(len(owner)) - begins[owner]) // FEATURES
    filters = np.zeros((slots[-1], BITS // 8), np.uint8)
    for h in range(HASHES):
        bit = (hashed >> np.uint64(11 * h) & np.uint64(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(filters, (slot, bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    counts = np.bincount(slot, minlength=slots[-1])
    packed = filters.view(np.uint64)
    return [Digest(packed[slots[i] : slots[i + 1]], counts[slots[i] : slots[i + 1]]) for i in range(len(texts))]


def likeness(one: Digest, two: Digest) -> float:
    """Likeness from 0 to 1: each filter of the digest with fewer features against its best match in the other.

    The overlap of two filters counts from what chance gives (and MARGIN of the rest) to the fewer of their
    bits; filters weigh by their features, and the sum is set against the geometric mean of both numbers of
    features (a text with repeated lines has few, which its longer edition still holds).
    Equal digests have 1, two empty ones too; an empty one is like no other.
    """
    sizes = int(one.counts.sum()), int(two.counts.sum())
    if not all(sizes):
        return float(sizes == (0, 0))
    if np.array_equal(one.filters, two.filters):
        return 1.0
    small, large = (one, two) if sizes[0] <= sizes[1] else (two, one)
    weight = np.bitwise_count(large.filters).sum(axis=1).astype(np.float64)
    shared = 0.0
    for f, n in zip(small.filters, small.counts.tolist(), strict=True):
        own = float(np.bitwise_count(f).sum())
        common = np.bitwise_count(large.filters & f).sum(axis=1)
        most, chance = np.minimum(own, weight), own * weight / BITS
        cut = chance + MARGIN * (most - chance)
        score = np.maximum(0.0, (common - cut) / np.maximum(most - cut, 1e-9))
        shared += float(np.minimum(score * np.minimum(n, large.counts), n).max())
    return min(1.0, shared / math.sqrt(sizes[0] * sizes[1]))


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as many first code points of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def entropy_ranks(docs: DataFrame) -> np.ndarray:
    """The rank table from all windows of all texts; at most LEVELS + 1 counts reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                texts = [t.encode() for t in _texts(batch.column("text"))]
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                levels = window_levels(np.frombuffer(b"".join(texts), np.uint8), bounds)
                total += np.bincount(levels[levels >= 0], minlength=LEVELS + 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["level", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "level int, n bigint")
    return rank_table({r["level"]: int(r["n"]) for r in found.groupBy("level").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()})


def _with_following(docs: DataFrame) -> DataFrame:
    """Rows in buckets of neighbouring ids, sorted in each, with the first row of the next bucket as a `guest` at its end.

    Bucket edges are quantiles of the ids; one row of each bucket, its first, is looked up. The texts are
    shuffled once.
    """
    spark = docs.sparkSession
    number = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_at", number)
    many = min(MOST_BUCKETS, max(1, docs.count() // BUCKET_ROWS))
    inner = rows.where("doc_id is not null").approxQuantile("_at", [i / many for i in range(1, many)], 1 / (8 * many)) if many > 1 else []
    edges = [float("-inf"), *sorted(set(inner)), float("inf")]
    dealt = Bucketizer(splits=edges, inputCol="_at", outputCol="_bucket").transform(rows) if len(edges) > 2 else rows.withColumn("_bucket", F.lit(0.0))
    dealt = dealt.select("doc_id", "text", F.col("_bucket").cast("int").alias("bucket"), F.xxhash64("text").alias("tie"))
    # One row per bucket, at most MOST_BUCKETS of them.
    heads = sorted(dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "tie")).alias("h")).collect())
    hosts = [(r["h"]["doc_id"], r["h"]["tie"], heads[i - 1]["bucket"]) for i, r in enumerate(heads)]
    wanted = spark.createDataFrame(hosts, "_id bigint, _tie bigint, _host int")
    guests = (
        dealt.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
        .dropDuplicates(["_host"]).select("doc_id", "text", F.col("_host").alias("bucket"), "tie", F.lit(True).alias("guest"))
    )
    every = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    order = ["bucket", "guest", F.asc_nulls_first("doc_id"), "tie"]
    return every.repartitionByRange("bucket").sortWithinPartitions(*order).select("bucket", "guest", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of the next greater doc_id; after the last comes the first. Rows with one
    doc_id follow one another by the hash of their text, null ids come first. A null text is empty; an
    empty text has the empty fingerprint. Other columns are ignored; no rows give no rows. Equal texts have
    equal fingerprints within one call, whose ranks come from all its texts.
    """
    schema = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    ranks = entropy_ranks(docs)

    def rows(held: tuple | None, batch: pa.RecordBatch) -> tuple[tuple, pa.RecordBatch]:
        """The finished rows of a slice: the last one waits for its next document."""
        ids, buckets, guests = batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("guest").to_pylist()
        texts = _texts(batch.column("text"))
        own = digests([t.encode() for t in texts], ranks)
        table = ([held] if held else []) + list(zip(buckets, guests, ids, texts, own, strict=True))
        pairs = [(a, b) for a, b in zip(table, table[1:], strict=False) if not a[1] and a[0] == b[0]]
        changed = [edited(a[3], b[3]) for a, b in pairs]
        raw = [t.encode() for t in changed]
        theirs = digests(raw, ranks)
        columns = [
            [a[2] for a, _ in pairs], [len(a[3]) for a, _ in pairs], [hashlib.sha256(r).hexdigest() for r in raw],
            [a[4].text() for a, _ in pairs], [d.text() for d in theirs],
            [likeness(a[4], d) for (a, _), d in zip(pairs, theirs, strict=True)], [likeness(a[4], b[4]) for a, b in pairs],
        ]
        return table[-1], pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    arrow_schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                held, done = rows(held, batch)
                yield done

    return _with_following(docs).mapInArrow(run, schema)
