"""Token-id files compressed by Re-Pair, one grammar per block, with random access to each document.

A block holds whole documents of about `BLOCK_IDS` ids. Frequent pairs of neighbouring ids are
replaced by nonterminals, many pairs a round, until no pair repeats often enough; a pair never joins
two documents, so each document is a run of the compressed sequence. The file keeps the rules, the
length that each nonterminal expands to, the sequence and where each document begins in it: one
document can be decoded without the others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import encoder, gathered, with_end
from .words import binary_array, slices

BLOCK_IDS = 1 << 19
SLICE_BYTES = 12 << 20
RULES_A_ROUND = 4096
LEAST = 4
FIRST_RULE = 1 << 20
SLOT_BITS = 16
COUNT_BITS = 20

FILE_SCHEMA = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("block_start", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_lengths", T.BinaryType()), T.StructField("doc_places", T.BinaryType()),
    T.StructField("rules", T.BinaryType()), T.StructField("rule_lengths", T.BinaryType()), T.StructField("sequence", T.BinaryType()),
])


def _hashed(pairs: np.ndarray, bits: int) -> np.ndarray:
    """The first `bits` bits of a hash of each pair."""
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


def _slot(pairs: np.ndarray) -> np.ndarray:
    return _hashed(pairs, SLOT_BITS)


def _pairs(seq: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    return seq[:-1][at].astype(np.uint64) << np.uint64(32) | seq[1:][at]


def _frequent(ordered: np.ndarray) -> tuple[np.ndarray, bool]:
    """The most frequent of some sorted pairs, at most RULES_A_ROUND, and whether that left others out."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(ordered)]]))
    often = np.flatnonzero(counts >= LEAST)
    best = often[np.argsort(-counts[often], kind="stable")[:RULES_A_ROUND]]
    return ordered[starts[best]], len(best) < len(often)


def _all_places(seq: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Chosen pairs, the places where they stand and which one stands there, from all pairs; and whether some wait."""
    pairs, inside = _pairs(seq, slice(None)), ~last[:-1]
    # Only pairs whose slot of a count table is met often enough can repeat so; few others have to be sorted. Pairs over
    # the end of a document are counted as well: they can only let more through.
    place = _hashed(pairs, COUNT_BITS)
    met = np.bincount(place, minlength=1 << COUNT_BITS) >= LEAST
    chosen, waiting = _frequent(np.sort(pairs[met[place] & inside]))
    # One pair per slot of a small table, the most frequent first: a look-up is one gather and one test. The others
    # wait for the next round.
    _, first = np.unique(_slot(chosen), return_index=True)
    waiting = waiting or len(first) < len(chosen)
    chosen = chosen[np.sort(first)]
    table, number = np.full(1 << SLOT_BITS, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)
    table[_slot(chosen)] = chosen
    number[_slot(chosen)] = np.arange(len(chosen))
    slot = place >> (COUNT_BITS - SLOT_BITS)
    at = np.flatnonzero((table[slot] == pairs) & inside)
    return chosen, at, number[slot[at]], waiting


def _new_places(seq: np.ndarray, last: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The same where no pair waits: only pairs with a symbol from `fresh` on can repeat often, for a replaced pair
    stands nowhere any more and the others were too rare before and do not become more."""
    young = seq >= fresh
    at = np.flatnonzero((young[:-1] | young[1:]) & ~last[:-1])
    pairs = _pairs(seq, at)
    chosen, waiting = _frequent(np.sort(pairs))
    if not len(chosen):
        return chosen, at[:0], at[:0], waiting
    order = np.argsort(chosen)
    found = np.minimum(np.searchsorted(chosen[order], pairs), len(chosen) - 1)
    hit = chosen[order][found] == pairs
    return chosen, at[hit], order[found[hit]], waiting


def _replace(seq: np.ndarray, last: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shorter sequence and its document ends. In a run of overlapping matches every other one is replaced, from the left."""
    run = np.concatenate([[True], np.diff(at) > 1])
    begin = at[np.flatnonzero(run)][np.cumsum(run) - 1]
    taken = (at - begin) % 2 == 0
    at = at[taken]
    out, ends = seq.copy(), last.copy()
    out[at] = number[taken]
    ends[at] = last[at + 1]
    keep = np.ones(len(seq), bool)
    keep[at + 1] = False
    return out[keep], ends[keep]


def compress(ids: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Grammar of the documents ids[bounds[i]:bounds[i + 1]]: rules, rule_lengths, sequence, places (n + 1)."""
    full = np.diff(bounds) > 0
    last = np.zeros(len(ids), bool)
    last[bounds[1:][full] - 1] = True
    seq, rules, lengths = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >= FIRST_RULE:
        raise ValueError(f"ids must be below {FIRST_RULE}")
    waiting, fresh = True, FIRST_RULE
    while len(seq) > 1:
        chosen, at, number, waiting = _all_places(seq, last) if waiting else _new_places(seq, last, fresh)
        if not len(chosen):
            break
        fresh = FIRST_RULE + len(rules)
        seq, last = _replace(seq, last, at, (fresh + number).astype(np.uint32))
        pairs = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        lengths = np.concatenate([lengths, _lengths(pairs, lengths).sum(axis=1, dtype=np.uint32)])
        rules = np.concatenate([rules, pairs])
    places = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.flatnonzero(last) + 1])
    return {"rules": rules, "rule_lengths": lengths, "sequence": seq, "places": ends[places].astype(np.uint32)}


def _lengths(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for."""
    own = symbols >= FIRST_RULE
    out = np.ones(symbols.shape, np.int64)
    out[own] = lengths[symbols[own].astype(np.int64) - FIRST_RULE]
    return out


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that a part of a compressed sequence stands for."""
    own = seq >= FIRST_RULE
    if not own.any():
        return seq.copy()
    rule = seq[own].astype(np.int64) - FIRST_RULE
    count = np.ones(len(seq), np.int64)
    count[own] = lengths[rule]
    held = int(lengths.sum(dtype=np.int64))
    if held > count.sum():
        return _by_levels(seq, rules)
    # Where all rules together stand for fewer ids than the sequence, each is expanded once.
    first = held + np.arange(len(seq))
    first[own] = (np.cumsum(lengths, dtype=np.int64) - lengths)[rule]
    return gathered(np.concatenate([_by_levels(rules.ravel(), rules), seq]), first, count)[0]


def _by_levels(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The same: every nonterminal gives way to its two symbols, level by level."""
    while len(own := np.flatnonzero(seq >= FIRST_RULE)):
        pairs = rules[seq[own].astype(np.int64) - FIRST_RULE]
        size = np.ones(len(seq), np.int8)
        size[own] = 2
        at = own + np.arange(len(own))
        seq = np.repeat(seq, size)
        seq[at], seq[at + 1] = pairs[:, 0], pairs[:, 1]
    return seq.copy()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of all documents, each followed by `end_id`, to Parquet files of grammar blocks in `path`.

    Files and blocks follow ascending doc_id; rows with one doc_id follow the hash of their text and
    all stay. A null text is `end_id` alone; null ids come first. No rows give no blocks. A task holds
    one block at a time, and a text longer than a block makes a block of its own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), encoder(tokenizer)
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = block = start = 0

        def block_row() -> pa.RecordBatch:
            ids = np.concatenate([h[0] for h in held])
            lengths = np.concatenate([h[1] for h in held])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            packed = compress(ids, bounds)
            row = {"part": part, "block": block, "block_start": start, "n_ids": len(ids),
                   "doc_ids": [i for h in held for i in h[2]],
                   "doc_lengths": lengths.astype("<u4").tobytes(), "doc_places": packed["places"].astype("<u4").tobytes(),
                   "rules": packed["rules"].astype("<u4").tobytes(), "rule_lengths": packed["rule_lengths"].astype("<u4").tobytes(),
                   "sequence": packed["sequence"].astype("<u4").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=arrow_schema)

        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, bounds = with_end(*words.encode(batch.column("text")), end_id)
                names, begin = batch.column("doc_id").to_pylist(), 0
                while begin < len(names):
                    stop = int(np.searchsorted(bounds, bounds[begin] + BLOCK_IDS - size, side="right"))
                    stop = min(max(stop - 1, begin if size else begin + 1), len(names))
                    if stop > begin:
                        held.append((ids[bounds[begin] : bounds[stop]], np.diff(bounds[begin : stop + 1]), names[begin:stop]))
                        size += int(bounds[stop] - bounds[begin])
                        begin = stop
                    if begin < len(names):
                        yield block_row()
                        start, block, size, held = start + size, block + 1, 0, []
        if held:
            yield block_row()

    arrow_schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("block_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        *[(c, pa.binary()) for c in ("doc_lengths", "doc_places", "rules", "rule_lengths", "sequence")]])
    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    )
    ordered.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files of `write_ids`: doc_id, start (ids of all documents before it), n_tokens, tokens (binary).

    Where a part begins follows from the sums of the parts before it: one number per written part goes to the
    driver and back with the tasks, the blocks stay where they are.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    sums = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    before = dict(zip((p for p, _ in sums), itertools.accumulate((n for _, n in sums), initial=0), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = {c: np.frombuffer(row[c], "<u4") for c in ("doc_lengths", "rules", "rule_lengths", "sequence")}
                ids = expand(part["sequence"], part["rules"].reshape(-1, 2), part["rule_lengths"])
                lengths = part["doc_lengths"].astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                start = before[row["part"]] + row["block_start"] + bounds[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()),
                     binary_array(ids, bounds * 4)], names=["doc_id", "start", "n_tokens", "tokens"])

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, tokens binary")


def document_ids(block: dict, nth: int) -> np.ndarray:
    """The ids of one document of a block (a row of the files), without decoding the others."""
    part = {c: np.frombuffer(block[c], "<u4") for c in ("doc_places", "rules", "rule_lengths", "sequence")}
    begin, end = part["doc_places"][nth : nth + 2]
    return expand(part["sequence"][begin:end], part["rules"].reshape(-1, 2), part["rule_lengths"])
