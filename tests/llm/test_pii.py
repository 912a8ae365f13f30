"""Personal data against the plain patterns."""

import hashlib
import re

from pyspark.sql import functions as F

from kpivane.llm import pii, queries
from tests.support import DATA

PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in match.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN for m in re.finditer(p, text or "") if valid(k, m.group())]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query_against_plain_patterns(spark):
    path = f"{DATA}/sf0.01"
    got = {r.doc_id: r for r in queries.op6_personal_data(spark, path).collect()}
    docs = queries.table(spark, path, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = brute(d.text), got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest() and r.spans.startswith(listed(base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]


ODD = ["a@b.c_d@e.f", "x@@y.z a@b", "++1 (22) 333-4444 55", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0001.2.3.4 1.2.3.999", "é𝒳 a.b@c-d.e.f, 4944339490429605",
       "4944-3394 9042-9605 1", "a@b.c.d@e.f@g.h", "", None, "a" * 30_000, "1" * 30_000, "1.2." * 3000, "+1" + "(" * 10_000, "1 2 " * 3000, "a@b.cc " * 200]


def test_edge_texts(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", pii.span_list(pii.base_spans("t"), (*pii.KINDS, "term")).alias("s"))
    for r in rows.collect():
        assert r.s == listed(brute(ODD[r.i])), ODD[r.i][:40]


def revealing(spark):
    rows = [(i, f"note{i} by Zorblax about thing{i % 3} reach bob@x.com or later item{i}") for i in range(8)]
    rows += [(i, f"common words about thing{i % 3} and later item{i}") for i in range(20, 80)]
    return spark.createDataFrame([*rows, (90, None), (91, ""), (None, "mail amy@x.org"), (60, "repeated id, zorblax again")], "doc_id bigint, text string")


def test_terms_that_reveal_a_value(spark):
    docs = revealing(spark)
    got = pii.personal_data(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        found = {texts[r.doc_id][s.start : s.end].lower() for s in r.terms}
        if r.doc_id is not None and r.doc_id < 8 and r.base:
            assert "zorblax" in found and not found & {"about", "later", "thing0", "thing1", "thing2"}
        else:
            assert not found
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_copies_alone_reveal_nothing(spark):
    docs = spark.createDataFrame([(i, "same secret context bob@x.com of a copy") for i in range(9)] + [(50 + i, f"other {i}") for i in range(40)], "doc_id bigint, text string")
    assert pii.personal_data(docs).where("size(terms) > 0").count() == 0


def test_sanitised_texts(spark):
    docs = revealing(spark).withColumn("n_chars", F.length("text").cast("bigint")).withColumn("spans", F.lit("clash"))
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = out.collect()
    first = next(r for r in rows if r.doc_id == 0)
    assert "[EMAIL]" in first.text and "[TERM]" in first.text and "bob" not in first.text and "Zorblax" not in first.text and first.n_chars == len(first.text)
    assert next(r for r in rows if r.doc_id is None).text == "mail [EMAIL]"
    assert {r.doc_id: r.text for r in rows if r.doc_id in (20, 90, 91)} == {r.doc_id: r.text for r in docs.collect() if r.doc_id in (20, 90, 91)}


def found_words(spark, rows):
    rows = rows + [(1000 + i, f"other words {i} of texts") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    return {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.terms} for r in pii.personal_data(docs).collect()}


def test_first_and_last_words_and_short_names(spark):
    got = found_words(spark, [(i, f"Zorblax can {i} be reached at Kim 李明 bob@x.com now {i} Quibnar") for i in range(6)])
    assert all({"Zorblax", "Quibnar", "Kim", "李明"} <= got[i] for i in range(6))


def test_names_far_from_the_value(spark):
    got = found_words(spark, [(i, f"Zorblax{' other words' * 20} {i}{' texts of' * 20} bob@x.com") for i in range(6)])
    assert all(got[i] >= {"Zorblax"} and not got[i] & {"other", "words", "texts"} for i in range(6))


def test_a_window_cuts_only_words_that_go_on(spark):
    texts = ["Zorblax" + "." * (pii.CONTEXT - 7) + "b@x.c", "xx Zorblax" + "." * (pii.CONTEXT - 7) + "b@x.c", "aZorblax" + "." * (pii.CONTEXT - 7) + "b@x.c"]
    frame = spark.createDataFrame([(t, t.index("b@")) for t in texts], "t string, a bigint").select(
        pii._near(F.col("t"), F.struct(F.col("a").alias("start"), (F.col("a") + 5).alias("end"))).alias("near"))
    assert ["Zorblax" in r.near for r in frame.collect()] == [True, True, False]
