"""Display text, markup and clean-up rules."""

import pytest
from pyspark.sql import functions as F

from kpivane.functions import display as ds
from kpivane.functions import markup as mk
from kpivane.functions import text as tx


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, value, *args):
        frame = spark.createDataFrame([(value,)], "t string")
        return frame.select(function(F.col("t"), *args).alias("x")).first().x

    return run


@pytest.mark.parametrize("raw, shown", [
    ("Up 12.5% to $250.40 by 2026-03-01", "Up **12.5%** to **$250.40** by **2026-03-01**"),
    ("moved +22 pp and 3.5 PP", "moved **+22 pp** and **3.5 PP**"),
    # The rules run one after the other: a later one still sees a signed or grouped number it may mark again.
    ("moved -3.5 PP to $1,250.40", "moved **-**3.5** PP** to **$**1,250**.40**"),
    ("already **80%** and 1,234,567 rows", "already **80%** and **1,234,567** rows"),
    ("−4.25 change", "**-4.25** change"),
    ("plain 7 stays", "plain 7 stays"),
    ("* first\n* second 5.5", "• first\n• second **5.5**"),
    ("", ""), ("  ", "  "),
])
def test_bold_numbers(apply, raw, shown):
    assert apply(mk.bold_numbers, raw) == shown


@pytest.mark.parametrize("raw, shown", [
    ("* item one\n• *Average up", "• item one\n• Average up"),
    ("word** and **bold** text", "word and bold text"), ("﻿market​ type", "market type"),
])
def test_normalize_bullets(apply, raw, shown):
    assert apply(mk.normalize_bullets, raw) == shown


def test_repair_and_title(apply):
    assert apply(mk.repair_bold, r"**M**arket \**x") == "Market x"
    assert apply(mk.strip_title, "**Sales**  fell *hard*\r\n") == "Sales fell hard"


@pytest.mark.parametrize("raw, name, value, shown", [
    ("In Self Generated the lead source fell", "lead_source", "Self-Generated", "In **Self Generated** the **lead source** fell"),
    ("Region West and Western", "region", "West", "**Region West** and Western"),
    ("Austin, TX rose; Austin fell", "city", "Austin, TX", "**Austin, TX** rose; Austin fell"),
    ("already **West** and west", "", "West", "already **West** and **west**"),
    ("A.B (x) done", "n/a", "A.B (x)", "**A.B (x)** done"),
    ("one two", "dim", "one; two", "**one** **two**"),
])
def test_highlight(spark, raw, name, value, shown):
    frame = spark.createDataFrame([(raw, name, value)], "t string, n string, v string")
    assert frame.select(mk.highlight(F.col("t"), F.col("n"), F.col("v")).alias("x")).first().x == shown


def test_phrases_longest_first(spark):
    frame = spark.createDataFrame([("lead_source", "Web")], "n string, v string")
    got = frame.select(mk.slice_phrases(F.col("n"), F.col("v")).alias("x")).first().x
    assert [len(p) for p in got] == sorted(map(len, got), reverse=True)
    assert {"Web", "lead source", "lead_source", "lead source — Web", "lead source: Web"} <= set(got)
    assert "lead source Web" not in got


def test_layout_sections(apply):
    raw = "Intro line\nSpend Mix — Observation of costs\n* first\n- second\n\nclosing text\n<sub>**Head**</sub>\n• only"
    assert apply(mk.layout_sections, raw) == (
        "Intro line\n\n<sub>**Spend Mix — Observation of costs**<sub>\n\n• first\n• second\n\nclosing text\n\n"
        "<sub>**Head**<sub>\n\n• only\n")
    assert apply(mk.layout_sections, "no header\nhere  ") == "no header\nhere\n"
    assert apply(mk.layout_sections, None) == "" and apply(mk.layout_sections, " \n") == ""


@pytest.mark.parametrize("line, header", [
    ("Spend Mix — Observation of costs", True), ("Spend Mix — observation of costs", False), ("A, B — Observation of costs", False),
    ("One two three four five six seven — Observation of costs", False), ("Spend Mix — Short", False),
    ("Channel – **Paid** Search fell sharply", True), ("Spend *Mix* — Observation of costs", False),
])
def test_title_lines(apply, line, header):
    assert apply(mk.layout_sections, line).startswith("<sub>") is header


def test_drift(spark):
    frame = spark.createDataFrame([("<sub>**A**<sub> b\n• c", "A b c", "A b d")], "a string, b string, c string")
    row = frame.select(
        mk.drifted(F.col("a"), F.col("b"), sections=True).alias("same"), mk.drifted(F.col("a"), F.col("c"), True).alias("other"),
        mk.drifted(F.lit("**x**  y"), F.lit("x y")).alias("bold")).first()
    assert (row.same, row.other, row.bold) == (False, True, False)


@pytest.mark.parametrize("name, value, shown", [
    ("net_close_rate", 0.21, "21%"), ("Share Pct", 43.5, "43.5%"), ("ratio of x", 0.5, "50%"), ("rationing", 0.5, "0.5"),
    ("revenue", 1250.0, "1250"), ("revenue", 0.005, "0.01"), ("revenue", None, "n/a"), ("headcount", 1.0, "1"), ("win %", 1.0, "100%"),
])
def test_metric_text(spark, name, value, shown):
    frame = spark.createDataFrame([(name, value)], "n string, v double")
    assert frame.select(ds.metric_text(F.col("n"), F.col("v")).alias("x")).first().x == shown


def test_number_texts(spark):
    row = spark.createDataFrame([(1234.5, None, -1234.9)], "a double, b double, c double").select(
        ds.currency_text(F.col("a")), ds.currency_text(F.col("b")), ds.integer_text(F.col("c")), ds.integer_text(F.col("b")),
        ds.decimal_text(F.col("a"), 1), ds.decimal_text(F.col("b")), ds.stored_number(F.lit(12345678.5)),
        ds.signed_percent(F.lit(11.0), F.lit(-10.0)), ds.signed_percent(F.lit(1.0), F.lit(0.0)),
        ds.clipped(F.lit("abcdef "), 4), ds.clipped(F.lit("abc"), 4),
    ).first()
    assert tuple(row) == ("$1,234.50", "$0.00", "-1,234", "0", "1,234.5", "0.00", "12345678.5", "+210.0%", "n/a", "abc…", "abc")


def test_labels_and_vague_terms(apply):
    assert apply(tx.humanize_labels, "by Branch_Name and sales_rep_ID2") == "by Branch Name and Sales Rep Id2"
    assert apply(tx.polish, "the KPI rose; current KPIs fell", F.lit("net_rate")) == "Net Rate rose; current Net Rate fell"
    assert apply(tx.polish, "the KPI and KPIs", F.lit("net_rate, leads")) == "Net Rate and metrics"
    assert apply(tx.polish, "main KPI", F.lit(None).cast("string")) == "the metrics"
    assert apply(tx.polish, "the KPI", F.lit("cost $1")) == "cost $1"


def test_jargon_and_routes(apply):
    assert apply(tx.scrub_jargon, "Up, but one WHY row shows x  and signal rows in signal_log") == (
        "Up; the rolling-baseline comparison shows x and alerts in the readings")
    assert apply(tx.strip_routes, "Route 2 — KPI dependency: cost rose (Route 1) fast\nroute 1 - region") == "cost rose fast\nregion"


def test_bullets_tags_words(apply):
    assert apply(tx.bullets, "- one\n\n• two • three\r\n¶four") == "• one\n• two\n• three\n• four"
    assert apply(tx.bullets, "a\nb\nc", 2) == "• a\n• b" and apply(tx.bullets, " \n") is None
    assert apply(tx.fixed_bullets, "1. call them", 3, ("pad",)) == "• call them\n• pad\n• pad"
    assert apply(tx.fixed_bullets, "", 3, ("pad",)) == ""
    assert apply(tx.tags, "a; b,,c, d", 3) == "a, b, c" and apply(tx.tags, "a; b,,c, d") == "a, b, c, d"
    assert apply(tx.first_words, "  a  b\nc d", 3) == "a b c"


@pytest.mark.parametrize("text, window, shown", [
    ("Sales fell", "2026-03-01 to 2026-03-07", "Sales fell. Period window: 2026-03-01 to 2026-03-07."),
    ("Fell!", "(mixed): a; b", "Fell! Periods are mixed; representative windows: (mixed): a; b."),
    ("Fell on 2026-03-01", "x", "Fell on 2026-03-01"), ("Fell", "n/a", "Fell"), ("", "x", ""),
])
def test_period_mention(apply, text, window, shown):
    assert apply(tx.mention_period, text, F.lit(window)) == shown


def test_whole_long_texts_pass(apply):
    long = ("Market share of West rose 12.5% in 2026-03-01. " * 2000).strip()
    out = apply(mk.reformat_body, long, F.lit("region"), F.lit("West"))
    assert out.count("**12.5%**") == 2000 and out.count("**West**") == 2000


def test_job_leaves_blank_fields(spark):
    rows = [(1, "**T**", "", None, "region", "West"), (2, None, "West 5.5", "A\n* b", "region", None)]
    frame = spark.createDataFrame(rows, "insight_id int, title string, insight string, why string, dimension_name string, dimension_value string")
    got = {r.insight_id: r for r in mk.reformat_insights(frame).collect()}
    assert (got[1].title, got[1].insight, got[1].why) == ("T", "", None)
    assert (got[2].title, got[2].insight, got[2].why) == ("", "West **5.5**", "A\n• b\n")


def test_pointers(spark):
    frame = spark.createDataFrame([(["one two three", " ", "up /green now"],)], "x array<string>")
    plain, marked = frame.select(tx.pointers(F.col("x"), "none", 3, 2), tx.pointers(F.col("x"), "none", 4, 3, True)).first()
    assert plain == ["one two", "up /green", "none"]
    assert marked == ["one two three /red", "up /green now", "none /red", "none /red"]


def test_bold_repair_of_long_runs_and_coloured_lines(spark):
    cases = {"**M****a****r****k****e****t****s**hare": "Marketshare", "**M****A**x": "**M**Ax", "**A**1": "**A**1", "**a** b": "**a** b"}
    frame = spark.createDataFrame([(k,) for k in cases], "t string").select("t", mk.repair_bold(F.col("t")).alias("out"))
    assert {r.t: r.out for r in frame.collect()} == cases
    late = " ".join(f"w{i}" for i in range(14)) + " /green"
    row = spark.createDataFrame([([late],)], "x array<string>").select(tx.pointers(F.col("x"), "none", 1, coloured=True)[0].alias("a"), tx.pointers(F.col("x"), "none", 1)[0].alias("b")).first()
    assert row.a == late and row.b == " ".join(f"w{i}" for i in range(10))


def test_markup_of_many_marks_ends_early(spark):
    from time import monotonic
    many = spark.createDataFrame([(1, "**a** " * 60_000), (2, "<sub> " * 9 + "x"), (3, "** \t b **"), (4, "a \n b  c\td"), (5, None), (6, "**a")], "i int, t string")
    begun = monotonic()
    got = {r.i: r.p for r in many.select("i", mk.plain_text(F.col("t")).alias("p")).collect()}
    assert monotonic() - begun < 20
    assert got == {1: "a " * 59_999 + "a", 2: "<sub> x", 3: "b", 4: "a b c d", 5: "", 6: "**a"}


def test_bold_rules_alone_and_by_sign(spark):
    texts = {"on 2024-01-05": "on **2024-01-05**", "by 3 pp": "by **3 pp**", "by 3PP": "by **3 PP**", "up 7%": "up **7%**", "at $ 5": "at **$ 5**",
             "1,250 of": "**1,250** of", "x 0.5": "x **0.5**", "12 of 7": "12 of 7"}
    assert all(not sign or sign.replace("**", "*") in pattern for sign, pattern, _ in mk.BOLD_RULES)
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.b for r in frame.select("t", mk.bold_numbers(F.col("t")).alias("b")).collect()} == texts
