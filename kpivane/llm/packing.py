"""Best-fit packing by minimum bin slack.

The plan needs only how many pieces there are of each length (at most `capacity` numbers, whatever
the corpus holds). For each sequence a bitset subset-sum over the lengths still available finds the
fullest feasible combination beside the longest piece left; it is removed as often as the counts
allow, so the plan has about as many patterns as there are lengths. Pieces then take their places by
their rank within their length, which is found in blocks and never gathers a length in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import encoder, with_end
from .words import binary_array, slices

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, tokens binary"
RANK_BLOCK = 500_000
SLICE_BYTES = 2 << 20


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Each document's ids plus `end_id`, in pieces of at most `capacity` ids.

    One row per piece with `tokens`, its ids as little-endian unsigned 32-bit numbers. A null or empty
    text is one piece holding `end_id` alone; a null doc_id stays null; repeated rows each give pieces.
    Other columns are ignored. Texts are handled two megabytes at a time: a task holds
    many times their size in words and ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                ids, bounds = with_end(*words.encode(batch.column("text")), end_id)
                sizes = np.diff(bounds)
                counts = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), binary_array(ids, np.concatenate([bounds[owner] + start, bounds[-1:]]) * 4)],
                    names=["doc_id", "piece", "start", "length", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


class Plan(NamedTuple):
    """Intervals of ranks: pieces `first`.. of `length`, `each` per sequence from `sequence` on, at `offset`."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def fullest(lengths: list[int], counts: Mapping[int, int], room: int) -> list[tuple[int, int]]:
    """The available lengths with the largest total that is at most `room`, as (length, how many).

    `lengths` come in falling order; among equal totals the longer pieces are used first.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        left = min(counts[length], room // length)
        take = 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return sorted(chosen.items(), reverse=True)


def minimum_bin_slack(counts: Mapping[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of (length, how many) with the number of sequences filled by each; every piece is used."""
    left = {length: count for length, count in counts.items() if count}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    patterns = []
    while left:
        longest = max(left)
        left[longest] -= 1
        others = sorted((n for n, c in left.items() if c and n <= capacity - longest), reverse=True)
        pattern = dict(fullest(others, left, capacity - longest))
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[n] // m for n, m in pattern.items())
        for n, m in pattern.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
        patterns.append((sorted(pattern.items(), reverse=True), times))
    return patterns


def make_plan(counts: Mapping[int, int], capacity: int) -> Plan:
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in minimum_bin_slack(counts, capacity):
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += each * times
            offset += length * each
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences=sequence)


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add `sequence_id` and `offset` (gapless from 0) to pieces with doc_id, piece and length.

    `pieces` is read twice and should be a written table. Other columns are carried along; ones named
    sequence_id or offset are replaced. Rows that are equal in everything take different places. No
    rows give no rows; a length below 1 or above `capacity` is an error.
    """
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(counts, capacity)
    blocks = 64 + sum(counts.values()) // RANK_BLOCK
    dealt = pieces.select(*keep, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).alias("_block"))
    before = (
        dealt.groupBy("length", "_block").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(
            Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("_inside", inside).join(before, ["length", "_block"])

    span = int(max(counts.values(), default=0)) + 1
    keys = plan.length * span + plan.first

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * span + rank.to_numpy(), side="right") - 1
        nth = rank.to_numpy() - plan.first[at]
        return pd.DataFrame({
            "sequence_id": plan.sequence[at] + nth // plan.each[at],
            "offset": plan.offset[at] + nth % plan.each[at] * length.to_numpy(),
        })

    placed = ranked.withColumn("_place", place("length", F.col("_before") + F.col("_inside") - 1))
    return placed.select(*keep, "_place.sequence_id", "_place.offset")
