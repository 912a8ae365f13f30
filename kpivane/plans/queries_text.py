"""Text jobs over stored narratives, here the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display as ds
from ..functions import markup as mk
from ..functions import text as tx
from ..sources.tables import Tables
from . import sql as q
from .registry import query

_PERCENT = "regexp_matches(lower({n}), '%|percent|pct|rate')"


@query("metric_display", f"""WITH m AS (SELECT o_orderkey, n, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN n = 'order_value' THEN o_totalprice ELSE round(o_totalprice / 300000, 4) END AS v
FROM orders, (VALUES ('order_value'), ('Net Close Rate'), ('share_pct')) x(n))
SELECT o_orderkey, n AS metric, coalesce(CASE WHEN {_PERCENT.format(n='n')} THEN {q.trimmed(q.scale100('v'))} || '%' ELSE {q.trimmed('v')} END, 'n/a') AS shown FROM m""")
def metric_display(t: Tables) -> DataFrame:
    """Metric levels as display text, percent-like names on the percent scale."""
    price, name = F.col("o_totalprice"), F.col("metric")
    names = F.explode(F.array(F.lit("order_value"), F.lit("Net Close Rate"), F.lit("share_pct")))
    value = F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).when(name == "order_value", price).otherwise(F.round(price / 300000, 4))
    return t("orders").withColumn("metric", names).select("o_orderkey", "metric", ds.metric_text(name, value).alias("shown"))


@query("number_text", """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS v FROM orders)
SELECT o_orderkey, coalesce('$' || format('{:,.2f}', v), '$0.00') AS money, coalesce(format('{:,}', CAST(trunc(v) AS BIGINT)), '0') AS whole,
  coalesce(format('{:,.2f}', v), '0.00') AS number FROM m""")
def number_text(t: Tables) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice"))
    return t("orders").select("o_orderkey", ds.currency_text(value).alias("money"), ds.integer_text(value).alias("whole"),
                              ds.decimal_text(value).alias("number"))


def narratives(t: Tables) -> DataFrame:
    """Documents as stored narratives: a title, a body, and the language and source as their slice."""
    text = F.col("text")
    return t("documents").select(
        F.col("doc_id").alias("insight_id"), F.element_at(F.split(text, "\n"), 1).alias("title"), text.alias("insight"),
        F.concat(F.lit("Spend Mix — Observation of 12.5% in "), F.col("source"), F.lit("\n* first 1,250\n- second $3,400.50\n"), text).alias("why"),
        F.lit("source_name").alias("dimension_name"), F.col("source").alias("dimension_value"))


@query("markup_job")
def markup_job(t: Tables) -> DataFrame:
    """The markup pass over every narrative, whole texts."""
    return mk.reformat_insights(narratives(t))


@query("markup_titles", r"""SELECT doc_id, regexp_replace(regexp_replace('Doc ' || doc_id || ' ' || replace(string_split(text, chr(10))[1], '*', ''), '\s{2,}', ' ', 'g'),
  '^\s+|\s+$', '', 'g') AS title FROM documents""")
def markup_titles(t: Tables) -> DataFrame:
    """Titles without stars and with single blanks."""
    first = F.element_at(F.split("text", "\n"), 1)
    return t("documents").select("doc_id", mk.strip_title(
        F.concat(F.lit("**Doc** *"), F.col("doc_id").cast("string"), F.lit("*  "), first)).alias("title"))


@query("markup_drift", r"""SELECT doc_id, FALSE AS changed_by_markup, TRUE AS changed_by_word,
  trim(regexp_replace(text, '\s+', ' ', 'g')) = '' AS blank FROM documents""")
def markup_drift(t: Tables) -> DataFrame:
    """Markup alone is no drift; an added word is."""
    text = F.col("text")
    marked = F.concat(F.lit("<sub>**Header**<sub>\n "), text)
    return t("documents").select(
        "doc_id",
        mk.drifted(F.concat(F.lit("Header "), text), marked).alias("changed_by_markup"),
        mk.drifted(text, F.concat(text, F.lit(" word"))).alias("changed_by_word"),
        (tx.strip_space(text) == "").alias("blank"))


@query("humanize_labels", """WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'order_value' ELSE 'order_value, revenue' END AS label FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0
  THEN 'current Order Value of Branch Name ' || o_orderkey || ' and drivers; Order Value is up.'
  ELSE 'current reading of Branch Name ' || o_orderkey || ' and drivers; Order Value is up.' END AS said FROM m""")
def humanize_labels(t: Tables) -> DataFrame:
    """Schema tokens, vague KPI wording, analyst terms and scaffolding rewritten as plain words."""
    key = F.col("o_orderkey")
    label = F.when(key % 2 == 0, "order_value").otherwise("order_value, revenue")
    raw = F.concat(F.lit("Route 2 — KPI dependency: current KPI of branch_NAME "), key.cast("string"),
                   F.lit(" and  WHY rows; the KPI is up. (Route 1) "))
    said = tx.polish(tx.scrub_jargon(tx.strip_routes(raw)), label)
    return t("orders").select("o_orderkey", said.alias("said"))


@query("humanize_documents", r"""SELECT doc_id, length(text) > 0 AS has_text FROM documents""")
def humanize_documents(t: Tables) -> DataFrame:
    """The same rules over whole documents, none of which may lose its text."""
    said = tx.polish(F.col("text"))
    return t("documents").select("doc_id", (F.length(said) > 0).alias("has_text"))


@query("bullet_normalize", r"""WITH parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\r\n¶•]'),
  lambda p: regexp_replace(regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '^[-*–—]\s*', ''), '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS x, text FROM documents)
SELECT doc_id, array_to_string(list_transform(x[1:30], lambda p: '• ' || p), chr(10)) AS lines,
  array_to_string(list_transform(list_concat(x, ['pad', 'pad', 'pad', 'pad', 'pad'])[1:5], lambda p: '• ' || p), chr(10)) AS five,
  array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:18], ' ') AS title FROM parts""")
def bullet_normalize(t: Tables) -> DataFrame:
    """Bullet lines, exactly five of them with padding, and a title of at most 18 words."""
    text = F.col("text")
    items = tx.bullet_items(text)
    five = F.slice(F.concat(items, F.array_repeat(F.lit("pad"), 5)), 1, 5)
    return t("documents").select(
        "doc_id", tx.bullets(text, 30).alias("lines"),
        F.array_join(F.transform(five, lambda p: F.concat(F.lit("• "), p)), "\n").alias("five"),
        tx.first_words(text, 18).alias("title"))


@query("tag_cap", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN l_returnflag || ', ' || l_linestatus
  ELSE l_returnflag || ', ' || l_linestatus || ', third' END AS tags FROM lineitem""")
def tag_cap(t: Tables) -> DataFrame:
    """At most three tags, separators and blanks tidied."""
    n, flag, status = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")
    raw = F.when(n % 3 == 0, " ; ,").when(n % 3 == 1, F.concat(flag, F.lit(" ;"), status)).otherwise(
        F.concat(flag, F.lit(","), status, F.lit(",, third ; fourth, fifth")))
    return t("lineitem").select("l_orderkey", "l_linenumber", tx.tags(raw, 3).alias("tags"))


@query("period_mention", """WITH m AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Sales rose on 1998-04-02' WHEN 1 THEN 'Sales rose' WHEN 2 THEN 'Sales rose.' ELSE ' ' END AS t,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, o_orderkey % 3 = 0 AS na FROM orders)
SELECT o_orderkey, CASE WHEN trim(t) = '' THEN '' WHEN na OR t LIKE '%1998-04-02' THEN t
  ELSE t || CASE WHEN t LIKE '%.' THEN ' ' ELSE '. ' END || 'Period window: ' || d || '.' END AS said FROM m""")
def period_mention(t: Tables) -> DataFrame:
    """The window is named when the text has no date of its own."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date").cast("string")
    said = F.when(key % 4 == 0, "Sales rose on 1998-04-02").when(key % 4 == 1, "Sales rose").when(key % 4 == 2, "Sales rose.").otherwise(" ")
    window = F.when(key % 3 == 0, "n/a (none)").otherwise(day)
    return t("orders").select("o_orderkey", tx.mention_period(said, window).alias("said"))


@query("summary_pointers", r"""WITH parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda p:
  array_to_string(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')[1:10], ' ')), lambda p: p <> '') AS x,
  list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda p: array_to_string(list_filter(regexp_split_to_array(
  array_to_string(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')[1:20], ' ') || CASE WHEN doc_id % 2 = 0 THEN ' /green' ELSE '' END, '\s+'),
  lambda w: w <> '')[1:30], ' ')), lambda p: p <> '') AS y FROM documents)
SELECT doc_id, array_to_string(list_concat(x, ['none', 'none', 'none', 'none', 'none'])[1:5], chr(10)) AS plain,
  array_to_string(list_transform(list_concat(y, ['none', 'none', 'none', 'none', 'none'])[1:5],
    lambda p: CASE WHEN p LIKE '%/green%' OR p LIKE '%/red%' THEN p ELSE p || ' /red' END), chr(10)) AS coloured FROM parts""")
def summary_pointers(t: Tables) -> DataFrame:
    """Five short summary lines per text, plain and with a colour mark (for even ids after up to 20 words)."""
    lines = F.split("text", "\n")
    mark = F.when(F.col("doc_id") % 2 == 0, " /green").otherwise("")
    late = F.transform(lines, lambda p: F.concat(tx.first_words(p, 20), mark))
    return t("documents").select(
        "doc_id", F.array_join(tx.pointers(lines, "none"), "\n").alias("plain"),
        F.array_join(tx.pointers(late, "none", coloured=True), "\n").alias("coloured"))
