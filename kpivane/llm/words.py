"""Words and word shingles of text columns as numpy arrays, for work inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20


class Words(NamedTuple):
    """The words of some texts: `codes` index `vocabulary`; text i owns codes[bounds[i]:bounds[i + 1]]."""

    codes: np.ndarray
    bounds: np.ndarray
    vocabulary: pa.Array


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most `limit` bytes (a longer text comes alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> Words:
    """Words between runs of the six ASCII white-space characters. A null text has no words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    flat = pc.list_flatten(lists)
    bounds = np.concatenate([[0], ends])
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():
        bounds = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[bounds]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, coded.dictionary)


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.as_buffer()) for w in vocabulary.cast(pa.binary())), np.uint64, len(vocabulary))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(seed: int, count: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, A-Z lower-cased.

    A text of fewer words is one shingle of all its words; one without words has none.
    """
    words = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = word_hashes(words.vocabulary)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    factors = odd_numbers(20_011, size)
    rolled = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for i in range(size):
        rolled += hashed[i : i + len(rolled)] * factors[i]
    rolled = mixed(rolled)
    out = []
    for begin, end in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if end - begin >= size:
            out.append(np.unique(rolled[begin : end - size + 1]))
        elif end > begin:
            few = hashed[begin:end] * factors[: end - begin]
            out.append(mixed(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(end - begin)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def binary_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column over one buffer; `bounds` are byte positions."""
    raw = np.ascontiguousarray(data).view(np.uint8)
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]
    ).cast(pa.binary())


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, one batch for each run of equal `keys` (integers or strings without nulls)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        changed[0] = bool(held) and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys)
        begin = 0
        for at in np.flatnonzero(changed).tolist():
            if at > begin:
                held.append(batch.slice(begin, at - begin))
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, begin = [], at
        held.append(batch.slice(begin))
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)
