"""Quality scores by a factorisation machine.

Inputs of a document: its hashed words, statistics of its structure and its declared size. The model
has a weight and a short vector for each input; the interactions of all pairs are the difference of
the square of the sum and the sum of the squares of those vectors, so a score takes time linear in
the number of inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, training_rows, with_texts
from .words import slices, split_words, word_hashes

BUCKETS = 1 << 13
FACTORS = 4
MOST_ROWS = 6_000
STATISTICS = 12


class Inputs(NamedTuple):
    """Sparse word inputs (row, bucket, value) and dense statistics of n documents."""

    row: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    dense: np.ndarray


class Machine(NamedTuple):
    centre: np.ndarray
    spread: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, x: Inputs) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_raw(x, self.standard(x.dense), self.bias, self.weight, self.factor)[0], -30, 30)))

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.centre) / self.spread, -4, 4)


def inputs(texts: pa.Array, sizes: pa.Array) -> Inputs:
    """Inputs of whole texts; `sizes` is the declared size, the text's own where it is null."""
    words = split_words(texts)
    n, known = len(texts), words.vocabulary
    count = np.diff(words.bounds)
    owner = np.repeat(np.arange(n), count)

    def total(of_word: np.ndarray) -> np.ndarray:
        return np.bincount(owner, of_word[words.codes], n) if len(owner) else np.zeros(n)

    def number(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(known, pattern).to_numpy(zero_copy_only=False).astype(np.float64)

    chars = pc.utf8_length(known).to_numpy(zero_copy_only=False).astype(np.float64)
    capital, digit, symbol = number(r"\p{Lu}"), number(r"[0-9]"), number(r"[^\p{L}\p{N}.,]")
    same = np.zeros(len(owner))
    if len(owner) > 1:
        same[1:] = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    length, some = np.maximum(total(chars), 1), np.maximum(count, 1)
    bucket_of = (word_hashes(pc.utf8_lower(known)) % np.uint64(BUCKETS)).astype(np.int64)
    cells, times = np.unique(owner * BUCKETS + bucket_of[words.codes], return_counts=True)
    row, bucket = cells // BUCKETS, cells % BUCKETS
    value = times.astype(np.float64)
    norm = np.sqrt(np.bincount(row, value * value, n)) if n else np.zeros(0)
    own = pc.fill_null(pc.utf8_length(texts), 0)
    size = pc.fill_null(pc.cast(sizes, pa.int64()), own.cast(pa.int64())).to_numpy(zero_copy_only=False).astype(np.float64)
    dense = np.stack([
        np.log1p(count), np.log1p(np.maximum(size, 0)), total(chars) / some, total(capital) / length, total(digit) / length,
        total(symbol) / length, total((symbol > 0).astype(float)) / some, total((chars == 1).astype(float)) / some,
        np.bincount(owner, same, n) / some if len(owner) else np.zeros(n), np.bincount(row, minlength=n) / some,
        (np.maximum.reduceat(np.append(value, 0), np.searchsorted(row, np.arange(n))) if len(row) else np.zeros(n)) / some,
        total((capital == chars).astype(float)) / some,
    ], axis=1)
    return Inputs(row, bucket, value / np.maximum(norm, 1e-9)[row], dense)


def _raw(x: Inputs, dense: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
    """Scores before the logistic function, and the factor sums that the gradient needs."""
    n = len(dense)

    def by_row(v: np.ndarray) -> np.ndarray:
        return np.bincount(x.row, v, n)

    linear = bias + by_row(weight[x.bucket] * x.value) + dense @ weight[BUCKETS:]
    sums = np.stack([by_row(factor[x.bucket, f] * x.value) + dense @ factor[BUCKETS:, f] for f in range(factor.shape[1])], axis=1)
    squares = by_row((factor[x.bucket] ** 2).sum(axis=1) * x.value**2) + dense**2 @ (factor[BUCKETS:] ** 2).sum(axis=1)
    return linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def fit(x: Inputs, label: np.ndarray, epochs: int = 150, rate: float = 0.05, shrink: float = 1e-4) -> Machine:
    """Full-batch adaptive gradient descent on the logistic loss, classes weighted by their true shares."""
    centre, spread = (x.dense.mean(axis=0), x.dense.std(axis=0) + 1e-6) if len(label) else (np.zeros(STATISTICS), np.ones(STATISTICS))
    machine = Machine(centre, spread, 0.0, np.zeros(BUCKETS + STATISTICS),
                      np.random.default_rng(5).normal(0, 0.02, (BUCKETS + STATISTICS, FACTORS)))
    if not len(label):
        return machine._replace(factor=np.zeros_like(machine.factor))
    dense, n = machine.standard(x.dense), len(label)
    share = np.clip(label.mean(), 1 / (n + 1), n / (n + 1))
    bias, weight, factor = np.log(share / (1 - share)), machine.weight, machine.factor
    seen = [0.0, np.zeros_like(weight), np.zeros_like(factor)]
    for _ in range(epochs):
        y, sums = _raw(x, dense, bias, weight, factor)
        g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label) / n
        gw = np.concatenate([np.bincount(x.bucket, g[x.row] * x.value, BUCKETS), g @ dense]) + shrink * weight
        gv = np.empty_like(factor)
        for f in range(FACTORS):
            cells = g[x.row] * x.value * (sums[x.row, f] - factor[x.bucket, f] * x.value)
            gv[:BUCKETS, f] = np.bincount(x.bucket, cells, BUCKETS)
            gv[BUCKETS:, f] = (g * sums[:, f]) @ dense - (g @ dense**2) * factor[BUCKETS:, f]
        gv += shrink * factor
        for i, grad in enumerate((g.sum(), gw, gv)):
            seen[i] = 0.95 * seen[i] + 0.05 * grad**2
        bias -= rate * g.sum() / (np.sqrt(seen[0]) + 1e-8)
        weight = weight - rate * gw / (np.sqrt(seen[1]) + 1e-5)
        factor = factor - rate * gv / (np.sqrt(seen[2]) + 1e-5)
    return Machine(centre, spread, float(bias), weight, factor)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> Machine:
    """Fit on the texts of at most `most` labelled rows of each class, never on the held-out fifth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = inputs(batch.column("text"), batch.column("n_chars"))
                ends = np.searchsorted(x.row, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (x.bucket.astype(np.int32), x.value.astype(np.float32))]
                dense = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * STATISTICS, pa.array(x.dense.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists, dense],
                                                 names=["doc_id", "label", "bucket", "value", "dense"])

    rows = with_texts(_columns(docs), training_rows(labels, label, most)).select("doc_id", "label", "text", "n_chars")
    got = rows.mapInArrow(run, "doc_id bigint, label int, bucket array<int>, value array<float>, dense array<double>").toArrow().sort_by("doc_id")
    lengths = pc.list_value_length(got["bucket"]).to_numpy().astype(np.int64)
    x = Inputs(np.repeat(np.arange(got.num_rows), lengths), pc.list_flatten(got["bucket"]).to_numpy().astype(np.int64),
               pc.list_flatten(got["value"]).to_numpy().astype(np.float64), pc.list_flatten(got["dense"]).to_numpy().reshape(-1, STATISTICS))
    return fit(x, got["label"].to_numpy().astype(np.float64))


def _columns(docs: DataFrame) -> DataFrame:
    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), size.cast("bigint").alias("n_chars"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", most: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; one row per row of `docs`.

    A null or empty text is scored by its statistics alone. A null doc_id counts as held out. Without
    n_chars the text's own length stands in. With no labelled rows every score is 0.5. Other columns
    are ignored.
    """
    scored = scored_rows(_columns(docs), train(docs, labels, label, most))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scored_rows(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` (with text and n_chars) and `score`, which replaces a column of that name."""
    plain = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = machine.scores(inputs(batch.column("text").cast(pa.string()), batch.column("n_chars")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", most: int = MOST_ROWS) -> DataFrame:
    """The rows of `docs` whose score reaches the threshold, with their columns as they are."""
    sized = docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("bigint"))
    machine = train(docs, labels, label, most)
    own = scored_rows(sized.withColumnRenamed("score", "_own_score") if "score" in docs.columns else sized, machine)
    kept = own.where(F.col("score") >= threshold)
    return kept.select(*[F.col("_own_score").alias(c) if c == "score" else F.col(c) for c in docs.columns])
