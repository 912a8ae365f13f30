"""Mixing to target weights with soft membership.

Built-in functions only. A naive Bayes classifier over hashed words, counted on labelled documents,
gives each document posteriors over the domains. Rates (how often a document is to be seen) are fitted by
projected gradient steps on least squares: the expected tokens of each domain, the sum of rate x tokens x
posterior, shall meet the domain's target, and no rate is negative. A step moves every document by its own
posteriors against the domains' misses and cuts the rate at its bounds: a local expression on a table of
posteriors and rates, and one aggregate for the new sums.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import settled
from .labelled import with_texts

DOMAINS = ("good", "low", "toxic")
TARGET = {"good": 0.93, "low": 0.05, "toxic": 0.02}
EPOCHS = 1.25
BUCKETS = 4_096
MOST_ROWS = 4_000
WEIGHED_WORDS = 400
ROUNDS = 200
STEPS_A_TABLE = 8
RIDGE = 1e-9


class Classifier(NamedTuple):
    """Log prior of each domain, and its log probability of each word bucket."""

    prior: list[float]
    bucket: list[list[float]]


def domain(quality: Column, toxic: Column) -> Column:
    """Number of the labelled domain: toxic, else good by quality, else low; null where neither is known."""
    return F.when(toxic == 1, DOMAINS.index("toxic")).when(quality == 1, DOMAINS.index("good")).when(quality == 0, DOMAINS.index("low"))


def _buckets(docs: DataFrame, *keys: str) -> DataFrame:
    """`keys` and `bucket`, the hash of each white-space separated word; a text without words has one null bucket."""
    words = docs.select(*keys, F.explode_outer(F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), r"\s+")).alias("word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    return words.select(*keys, F.when(F.col("word") != "", bucket).alias("bucket"))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Classifier:
    """Counts over at most `most` labelled documents of each domain (smallest id hashes); what comes back is
    one row per bucket and domain. Priors come from all labels."""
    known = labels.select(F.col("doc_id").cast("bigint"), domain(F.col("quality"), F.col("toxic")).alias("domain")).where(
        "doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    share = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    rows = None
    for k in range(len(DOMAINS)):
        part = known.where(F.col("domain") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rows = part if rows is None else rows.unionByName(part)
    texts = with_texts(docs.select(F.col("doc_id").cast("bigint"), "text"), rows)
    counts = _buckets(texts, "domain").where("bucket is not null").groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()
    total = [0] * len(DOMAINS)
    cells = [[1.0] * BUCKETS for _ in DOMAINS]
    for r in counts:
        cells[r["domain"]][r["bucket"]] += r["n"]
        total[r["domain"]] += r["n"]
    prior = [math.log((share.get(k, 0) + 1) / (sum(share.values()) + len(DOMAINS))) for k in range(len(DOMAINS))]
    return Classifier(prior, [[math.log(c / (total[k] + BUCKETS)) for c in cells[k]] for k in range(len(DOMAINS))])


def rated(docs: DataFrame, model: Classifier) -> DataFrame:
    """One row per row of `docs`: doc_id, which (hash of the text), tokens and p, the posteriors.

    The words' evidence is scaled to that of WEIGHED_WORDS words at most, so long texts stay soft. A
    text without words has the priors. Words meet the model's table (one row per bucket) where they
    are; only a document's sums move.
    """
    size = range(len(DOMAINS))
    fields = ", ".join(["bucket int", *[f"w{k} double" for k in size]])
    weights = docs.sparkSession.createDataFrame([(b, *[row[b] for row in model.bucket]) for b in range(BUCKETS)], fields)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("which", F.xxhash64("text")).withColumn(
        "_row", F.monotonically_increasing_id())
    keys = ["doc_id", "which", "_row"]
    summed = _buckets(rows, *keys).join(F.broadcast(weights), "bucket", "left").groupBy(*keys).agg(
        F.count("bucket").alias("tokens"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in size])
    weight = F.lit(float(WEIGHED_WORDS)) / F.greatest(F.lit(float(WEIGHED_WORDS)), F.col("tokens").cast("double"))
    logs = summed.select("doc_id", "which", "tokens", *[(F.lit(model.prior[k]) + weight * F.col(f"s{k}")).alias(f"s{k}") for k in size])
    top = F.greatest(*[F.col(f"s{k}") for k in size])
    likely = logs.select("doc_id", "which", "tokens", *[F.exp(F.col(f"s{k}") - top).alias(f"e{k}") for k in size])
    total = sum((F.col(f"e{k}") for k in size), F.lit(0.0))
    return settled(likely.select("doc_id", "which", "tokens", F.array(*[F.col(f"e{k}") / total for k in size]).alias("p")))


def fitted(
    found: DataFrame, target: Mapping[str, float], epochs: float, most: float | None = None, rounds: int = ROUNDS, tolerance: float = 1e-5,
) -> DataFrame:
    """`found` (with p and tokens) and the rate of each row, written.

    Minimises the misses (S - T)' W (S - T) of the expected tokens S from the targets T over rates from 0 to
    `most`, from the rate 1 on. W is the inverse of sum(tokens x p x p'): with it the step 1 never
    overshoots, and is exact while no rate is cut. The fit ends when all targets are met to `tolerance`, or,
    where the bounds make them unreachable, when a step changes no sum by more than `tolerance` of its target.
    """
    size = range(len(DOMAINS))
    p = [F.get("p", F.lit(k)) for k in size]

    def sums(frame: DataFrame, *more: Column) -> np.ndarray:
        got = frame.agg(*[F.sum(F.col("rate") * F.col("tokens") * p[k]) for k in size], *more).first()
        return np.array([float(x or 0.0) for x in got])

    now = found.withColumn("rate", F.lit(1.0))
    got = sums(now, *[F.sum(F.col("tokens") * p[k] * p[j]) for k in size for j in size])
    have, spread = got[: len(DOMAINS)], got[len(DOMAINS) :].reshape(len(DOMAINS), len(DOMAINS))
    wanted = epochs * have[0] / target[DOMAINS[0]] * np.array([target[d] for d in DOMAINS])
    scale = np.maximum(wanted, 1.0)
    metric = np.linalg.inv(spread + np.diag(RIDGE * scale))
    for step in range(1, rounds + 1):
        if (np.abs(have - wanted) <= tolerance * scale).all():
            break
        gradient = (metric @ (have - wanted)).tolist()
        moved = F.greatest(F.lit(0.0), F.col("rate") - sum((p[k] * gradient[k] for k in size), F.lit(0.0)))
        now = now.withColumn("rate", moved if most is None else F.least(F.lit(float(most)), moved))
        if step % STEPS_A_TABLE == 0:
            now = settled(now)
        before, have = have, sums(now)
        if (np.abs(have - before) <= tolerance * scale).all():
            break
    return settled(now)


def _copies() -> Column:
    """The rate rounded up or down by a fixed draw of the document, so that sums meet the rates."""
    draw = F.pmod(F.xxhash64("doc_id", "which"), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(F.col("rate") + draw).cast("int")


def document_rates(
    docs: DataFrame, labels: DataFrame, target: Mapping[str, float] = TARGET, epochs: float = EPOCHS, most: float | None = None,
) -> DataFrame:
    """One row per row of `docs`: doc_id, tokens, the posteriors p_<domain>, rate and copies.

    `target` gives the share of each domain in the mixed tokens; the first domain is to be seen
    `epochs` times, which sets the total. `most` bounds the rates; targets that it makes unreachable are
    missed by the least squares. Tokens are white-space words; a null or blank text has none, the priors
    as posteriors, and takes no part in the sums. Repeated rows are documents of their own with equal
    rates. Without labels all posteriors are equal. Other columns are ignored; no rows give no rows.
    """
    rows = fitted(rated(docs, train(docs, labels)), target, epochs, most)
    return rows.select(
        "doc_id", "tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", _copies().alias("copies"))


def mixed_documents(
    docs: DataFrame, labels: DataFrame, target: Mapping[str, float] = TARGET, epochs: float = EPOCHS, most: float | None = None,
) -> DataFrame:
    """The rows of `docs` with all their columns, each as often as `document_rates` says (not at all at 0 copies).

    Rows of one doc_id and text are repeated alike; null ids and texts are ids and texts like others. Columns
    of any name may be there. No rows give no rows.
    """
    often = fitted(rated(docs, train(docs, labels)), target, epochs, most).select(
        F.col("doc_id").alias("_mix_id"), F.col("which").alias("_mix_which"), _copies().alias("_mix_copies")).dropDuplicates(["_mix_id", "_mix_which"])
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_mix_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_mix_which"))
    return docs.join(often.where("_mix_copies > 0"), same).withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)
