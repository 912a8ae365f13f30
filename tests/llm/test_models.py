"""Quality, toxicity and mixing models."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpivane.llm import mixing, quality, queries, toxicity
from kpivane.llm.labelled import training_rows
from tests.support import DATA

SMALL = f"{DATA}/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_training_rows_leave_out_the_held_out_fifth(spark):
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(200)], (7, 0), (None, 1), (300, None)], "doc_id bigint, quality int")
    rows = training_rows(labels, "quality", 30).collect()
    assert len(rows) == 60 and all(crc(r.doc_id) for r in rows)
    assert {r.doc_id: r.label for r in rows}.get(7, 0) == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality", "quality", 0.97), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    scored = queries.QUERIES[name](spark, SMALL)
    docs = queries.table(spark, SMALL, "documents")
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (crc(i) == 0) for i, r in rows.items())
    truth = [(r.doc_id, r[label]) for r in queries.table(spark, SMALL, "labels").collect() if crc(r.doc_id) == 0]
    assert np.mean([rows[i].predicted == y for i, y in truth]) >= least


def edge_rows(spark):
    return spark.createDataFrame(
        [(1, None, None, 9.0), (2, "", 0, 9.0), (3, "plain words here", None, 9.0), (3, "plain words here", None, 9.0), (None, "text", 4, 9.0),
         (4, "word " * 60_000, -5, 9.0)], "doc_id bigint, text string, n_chars bigint, score double")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_edge_cases(spark, module):
    docs, labels = edge_rows(spark), queries.table(spark, f"{DATA}/sf0.001", "labels")
    known = queries.table(spark, f"{DATA}/sf0.001", "documents").select("doc_id", "text", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000)
    labels = labels.withColumn("doc_id", F.col("doc_id") + 1000)
    result = module.score(docs.drop("score").unionByName(known), labels)
    assert result.columns == ["doc_id", "held_out", "score", "predicted"] and result.count() == 6 + known.count()
    rows = [r for r in result.collect() if r.doc_id is None or r.doc_id < 10]
    assert all(np.isfinite(r.score) for r in rows) and len({r.score for r in rows if r.doc_id == 3}) == 1
    assert next(r for r in rows if r.doc_id is None).held_out
    assert module.score(docs.limit(0), labels).count() == 0
    none = module.score(docs, labels.limit(0)).collect()
    assert len(none) == 6 and len({r.score for r in none}) == 1


def test_accepted_keeps_columns(spark):
    docs = edge_rows(spark)
    kept = quality.accepted(docs, queries.table(spark, f"{DATA}/sf0.001", "labels").limit(0), 0.3)
    assert kept.columns == docs.columns and kept.count() == 6 and {r.score for r in kept.collect()} == {9.0}


def test_the_factor_identity():
    rng = np.random.default_rng(0)
    x = quality.Inputs(np.array([0, 0, 0]), np.array([3, 9, 5]), np.array([0.5, 1.0, 2.0]), rng.normal(size=(1, quality.STATISTICS)))
    weight, factor = rng.normal(size=quality.BUCKETS + quality.STATISTICS), rng.normal(size=(quality.BUCKETS + quality.STATISTICS, 3))
    full = np.zeros(len(weight))
    full[x.bucket] = x.value
    full[quality.BUCKETS :] = x.dense[0]
    pairs = sum(full[i] * full[j] * (factor[i] @ factor[j]) for i in np.flatnonzero(full) for j in np.flatnonzero(full) if i < j)
    assert np.isclose(quality._raw(x, x.dense, 0.7, weight, factor)[0][0], 0.7 + full @ weight + pairs)


def test_inserted_characters_and_longer_words_are_found():
    rng = np.random.default_rng(2)
    syllables = ["ta", "re", "mon", "il", "sto", "va", "ne", "du", "per", "ga"]

    def sentence(n=30):
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n))

    clean = [sentence() for _ in range(400)]
    toxic = []
    for i in range(200):
        words = sentence().split()
        words[int(rng.integers(30))] = ["gruknoz", "blixwop"][i % 2]
        toxic.append(" ".join(words))
    judge = toxicity.fit(clean[:300] + toxic, np.repeat([0, 1], [300, 200]), 0.4)
    table = judge.table()
    bad = [sentence(10) + f" {w} " + sentence(10) for w in ("gruknoz", "blixwop", "g-r-u-k-n-o-z", "GRUKNOZ!", "b.lix.wop", "b l i x w o p", "xtagruknozta", "grukn0z")]
    assert (toxicity.scores(judge, table, bad) > 0.5).all()
    assert (toxicity.scores(judge, table, clean[300:]) < 0.5).mean() > 0.95


@pytest.mark.parametrize(("letters", "gap", "insults"), [
    ("абвгдежзийклмноп", " ", ("хуцчюш", "щъыьэф")), ("的一是不了人我在有他这中大来上国", "", ("笨猪", "蠢蛋")), ("אבגדהוזחטיכלמנ", " ", ("סעפצק", "רשתסע"))])
def test_insults_of_other_scripts_are_found(letters, gap, insults):
    rng = np.random.default_rng(4)

    def sentence(n=30):
        return gap.join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))

    clean = [sentence() for _ in range(400)]
    toxic = [sentence(12) + gap + insults[i % 2] + gap + sentence(12) for i in range(200)]
    judge = toxicity.fit(clean[:300] + toxic, np.repeat([0, 1], [300, 200]), 0.4)
    table = judge.table()
    assert (toxicity.scores(judge, table, [sentence(12) + gap + w + gap + sentence(12) for w in insults * 10]) > 0.5).mean() > 0.95
    assert (toxicity.scores(judge, table, clean[300:]) < 0.5).mean() > 0.9


def test_every_letter_has_a_symbol():
    for text in ("кот", "κακός", "קטן", "صغير", "ねこ", "개", "猫", "𠮷", "𝐛𝐚𝐝"):
        codes, _, place = toxicity.letters([text, "x"])
        assert (codes != 0).sum() >= len(text) + 1 and len(place) > len(text)
    for one, other in (("𝐛𝐚𝐝 ÉTÉ", "bad été"), ("ПРИВЕТ", "привет"), ("b@d", "bad")):
        assert (toxicity.letters([one])[0] == toxicity.letters([other])[0]).all()
    assert (toxicity.letters(["!?., 😀"])[0] == 0).all()


def test_the_decision_is_the_kernel_sum():
    words = ["badword", "another"]
    number, marks = toxicity._landmarks(words)
    codes, _, _ = toxicity.letters(["bad word, another one"])
    cut = toxicity._cut(codes, np.arange(20))
    values = toxicity._kernel(cut, number, marks)
    table = toxicity.Judge(number, marks[:, 0].astype(np.float32), 1.0, 0.0).table()
    assert np.allclose(toxicity.windows(table, codes)[:20], values[:, 0], atol=1e-4)


def test_a_text_is_scored_alone():
    rng = np.random.default_rng(1)
    judge = toxicity.Judge(np.arange(toxicity.NUMBERS), rng.normal(size=toxicity.NUMBERS).astype(np.float32), 0.1, 0.0)
    texts = ["", "a b c", "word", "é! next-one", "x" * 40, "  ", "last words here"] * 3
    table = judge.table()
    assert np.allclose(toxicity.scores(judge, table, texts), [toxicity.scores(judge, table, [t])[0] for t in texts], atol=1e-4)


def coordinate_descent(p, tokens, wanted, weight, most, rounds=3_000):
    """The least squares one rate at a time, for a few rows."""
    rate = np.ones(len(p))
    miss = (rate * tokens) @ p - wanted
    for _ in range(rounds):
        for i in range(len(p)):
            own = tokens[i] * p[i]
            curve = own @ weight @ own
            new = min(max(0.0, rate[i] - own @ weight @ miss / curve), most) if curve > 0 else rate[i]
            miss = miss + (new - rate[i]) * own
            rate[i] = new
    return rate


@pytest.mark.parametrize(("toxic", "most", "reachable"), [(16.0, 2.0, True), (2.0, 2.0, False), (2.0, None, True), (500.0, None, True), (16.0, 1.3, False)])
def test_rates_solve_the_least_squares(spark, toxic, most, reachable):
    """Scarce and abundant domains, with and without a bound on the rates, against another solver."""
    rng = np.random.default_rng(3)
    p = np.vstack([np.eye(3), [[0.9, 0.1, 0.0]], rng.dirichlet([0.5, 0.3, 0.2], 12)])
    tokens = np.concatenate([[900.0, 36.0, toxic, 50.0], rng.uniform(1, 4, 12)])
    found = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(p, tokens, strict=True)], "p array<double>, tokens double")
    got = mixing.fitted(found, mixing.TARGET, mixing.EPOCHS, most, rounds=60, tolerance=1e-6).collect()
    rate, p, tokens = (np.array([r[c] for r in got]) for c in ("rate", "p", "tokens"))
    have = tokens @ p
    wanted = mixing.EPOCHS * have[0] / mixing.TARGET["good"] * np.array([mixing.TARGET[d] for d in mixing.DOMAINS])
    sums = (rate * tokens) @ p
    assert (rate >= 0).all() and (most is None or (rate <= most + 1e-12).all())
    if reachable:
        assert np.allclose(sums, wanted, rtol=1e-4)
        return
    weight = np.linalg.inv((tokens[:, None] * p).T @ p)
    other = coordinate_descent(p, tokens, wanted, weight, most)
    miss, best = sums - wanted, (other * tokens) @ p - wanted
    assert np.isclose(miss @ weight @ miss, best @ weight @ best, rtol=5e-2)


def test_mixed_shares_are_the_targets(spark):
    rows = mixing.document_rates(queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels")).toPandas()
    sums = np.array([(rows.rate * rows.tokens * rows[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    assert np.allclose(sums / sums.sum(), [mixing.TARGET[d] for d in mixing.DOMAINS], atol=1e-4)
    assert np.isclose(sums[0], mixing.EPOCHS * (rows.tokens * rows.p_good).sum(), rtol=1e-4)
    assert (rows.rate >= 0).all() and (np.abs(rows.copies - rows.rate) < 1).all()
    assert np.allclose(rows[[f"p_{d}" for d in mixing.DOMAINS]].sum(axis=1), 1.0)


def test_mixing_edge_cases(spark):
    docs = edge_rows(spark).withColumn("rate", F.lit("clash")).withColumn("p", F.lit(1))
    labels = queries.table(spark, f"{DATA}/sf0.001", "labels")
    rates = mixing.document_rates(docs, labels)
    got = {r.doc_id: r for r in rates.collect()}
    assert rates.count() == 6 and got[1].tokens == 0 and got[4].tokens == 60_000
    mixed = mixing.mixed_documents(docs, labels)
    copies = {r.doc_id: r.copies for r in rates.groupBy("doc_id").agg(F.sum("copies").alias("copies")).collect() if r.copies}
    assert mixed.columns == docs.columns and {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies
    assert mixing.document_rates(docs.limit(0), labels).count() == 0
    assert mixing.document_rates(docs, labels.limit(0)).count() == 6
