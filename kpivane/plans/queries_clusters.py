"""Clusters, payloads, groups and summary blocks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import groups as gr
from ..sources.tables import Tables
from . import sql as q
from .queries_signals import HISTORY, SIGNALS, WHYS, base_signals, signal_history, stored_signals, stored_whys
from .registry import query
from .retail import GROUPS

SMALL_GATE = 6000


def _metric(name: str, x: str) -> str:
    shown = q.trimmed(f"CASE WHEN regexp_matches(lower({name}), '%|percent|pct|rate') AND abs({x}) <= 1.0000001 THEN {x} * 100 ELSE {x} END")
    return (f"coalesce({shown} || CASE WHEN regexp_matches(lower({name}), '%|percent|pct|rate|\\bratio\\b') THEN '%' ELSE '' END, 'n/a')")


_DRIVER = "coalesce(nullif(trim(dep_kpi_label), ''), nullif(trim(dep_kpi_name), ''), kpi_name)"
_LINE = f"""'WHY | main_metric=' || kpi_name || ' | signal_id=' || signal_id || ' | driver_metric ' || coalesce(dep_kpi_label, '—')
  || ' (dependent_driver_id=' || coalesce(dep_kpi_name, '—') || ') | driver_slice ' || dimension_name || ' — ' || dimension_value
  || ' | change_pct=' || coalesce(CAST(change_pct AS VARCHAR), 'None') || '% | current=' || {_metric(_DRIVER, 'current_value')}
  || ' | prev=' || {_metric(_DRIVER, 'prev_value')} || ' | Rationale: ' || rationale"""

_LINES = f"{WHYS}, lines AS (SELECT *, {_LINE} AS line FROM why), owned AS (SELECT lines.*, sig.kpi_name AS ck, sig.dimension AS cd, sig.dimension_value AS cv FROM lines JOIN sig USING (signal_id))"


def _standard(limit: int) -> str:
    return f"""{_LINES}, std AS (SELECT sha256(concat_ws('|', 'standard', s.kpi_name, s.dimension)) AS cluster_id, 'alpha' AS cluster_type, s.kpi_name,
  s.dimension AS dimension_name, left(s.dv, 4000) AS dimension_value, 'Mixed' AS period, s.n AS signal_count,
  s.ids AS signal_ids, coalesce(w.n, 0) AS why_count, coalesce(w.chars, 0) AS why_chars, coalesce(w.chars, 0) <= {limit} AS kept
FROM (SELECT kpi_name, dimension, count(*) AS n, string_agg(signal_id, ',' ORDER BY signal_id) AS ids,
    (SELECT string_agg(m, ', ' ORDER BY m) FROM (SELECT DISTINCT trim(s2.dimension_value) AS m FROM sig s2 WHERE s2.kpi_name = sig.kpi_name AND s2.dimension = sig.dimension)) AS dv
  FROM sig GROUP BY kpi_name, dimension) s
LEFT JOIN (SELECT ck, cd, count(*) AS n, length(string_agg(line, chr(10))) AS chars FROM owned GROUP BY 1, 2) w ON ck = s.kpi_name AND cd = s.dimension)"""


@query("cluster_standard", f"WITH {_standard(200000)} SELECT * FROM std")
def cluster_standard(t: Tables) -> DataFrame:
    """One cluster per KPI and dimension."""
    signals = stored_signals(t)
    return cl.standard_clusters(signals, stored_whys(t, signals), ids=True, member_chars=cl.MEMBER_CHARS)


@query("cluster_size_gate", f"""WITH {_standard(SMALL_GATE)} SELECT cluster_id, kpi_name, dimension_name, why_chars,
  'standard: ' || kpi_name || ' / ' || dimension_name || ' (why_text ' || why_chars || ' chars > {SMALL_GATE}; skipped)' AS reason FROM std WHERE NOT kept""")
def cluster_size_gate(t: Tables) -> DataFrame:
    """Clusters over a lowered size gate, with the reason."""
    signals = stored_signals(t)
    return cl.skip_report(cl.standard_clusters(signals, stored_whys(t, signals), SMALL_GATE), SMALL_GATE)


_LABEL = """CASE WHEN year(period_start) = year(period_end) AND month(period_start) = month(period_end)
  THEN day(period_start) || '-' || day(period_end) || ' ' || strftime(period_start, '%b') END"""


@query("cluster_dimensional", f"""WITH {_LINES} SELECT sha256(concat_ws('|', 'dimensional', cd, cv, CAST(period_start AS VARCHAR), CAST(period_end AS VARCHAR))) AS cluster_id,
  'dimensional' AS cluster_type, string_agg(DISTINCT ck, ', ' ORDER BY ck) AS kpi_name, cd AS dimension_name, cv AS dimension_value,
  {_LABEL} AS period, period_start, period_end, count(DISTINCT signal_id) AS signal_count, string_agg(DISTINCT signal_id, ',' ORDER BY signal_id) AS signal_ids,
  count(*) AS why_count, length(string_agg(line, chr(10))) AS why_chars, length(string_agg(line, chr(10))) <= 200000 AS kept
FROM owned WHERE lower(cd) IN ('priority', 'segment') GROUP BY cd, cv, period_start, period_end""")
def cluster_dimensional(t: Tables) -> DataFrame:
    """One cluster per slice and window, for two allowed dimensions."""
    signals = stored_signals(t)
    return cl.dimensional_clusters(signals, stored_whys(t, signals), ["Priority", " SEGMENT", "brand"], ids=True,
                                   kpi_items=cl.KPI_ITEMS, kpi_chars=cl.KPI_CHARS)


@query("cluster_signal_ids", f"""WITH {_LINES} SELECT DISTINCT sha256(concat_ws('|', 'standard', kpi_name, dimension)) AS cluster_id, 'alpha' AS cluster_type, signal_id FROM sig
UNION ALL SELECT DISTINCT sha256(concat_ws('|', 'dimensional', cd, cv, CAST(period_start AS VARCHAR), CAST(period_end AS VARCHAR))), 'dimensional', signal_id
FROM owned WHERE lower(cd) IN ('priority', 'segment')
UNION ALL SELECT DISTINCT sha256(concat_ws('|', 'rollup', lower(trim(kpi_name)))), 'rollup', signal_id FROM sig""")
def cluster_signal_ids(t: Tables) -> DataFrame:
    """Every cluster's signals as a long table, for standard, dimensional and roll-up clusters."""
    signals = stored_signals(t)
    return cl.cluster_signals(signals, stored_whys(t, signals), ["Priority", " SEGMENT", "brand"])


@query("cluster_json", f"""WITH {_LINES} SELECT sha256(concat_ws('|', 'dimensional', cd, cv, CAST(period_start AS VARCHAR), CAST(period_end AS VARCHAR))) AS cluster_id,
  string_agg(DISTINCT signal_id || ' ' || ck, ',' ORDER BY signal_id || ' ' || ck) AS signals,
  string_agg(signal_id || ' ' || kpi_name || ' ' || dimension_name || ' ' || dimension_value || ' ' || coalesce(dep_kpi_name, '-'), ',' ORDER BY
    signal_id || ' ' || kpi_name || ' ' || dimension_name || ' ' || dimension_value || ' ' || coalesce(dep_kpi_name, '-')) AS whys
FROM owned WHERE lower(cd) = 'segment' GROUP BY cd, cv, period_start, period_end""")
def cluster_json(t: Tables) -> DataFrame:
    """JSON arrays of the kept slices, read back and listed."""
    signals = stored_signals(t)
    packed = cl.bucket_json(signals, stored_whys(t, signals), ["segment"])
    one = "array<struct<signal_id:string,kpi_name:string,dimension_name:string,dimension_value:string,dep_kpi_name:string>>"

    def listed(column: str, *fields: str) -> Column:
        items = F.transform(F.from_json(column, one), lambda x: F.concat_ws(" ", *[F.coalesce(x[f], F.lit("-")) for f in fields]))
        return F.array_join(F.array_sort(items), ",")

    return packed.select(
        "cluster_id", listed("signals_json", "signal_id", "kpi_name").alias("signals"),
        listed("why_json", "signal_id", "kpi_name", "dimension_name", "dimension_value", "dep_kpi_name").alias("whys"))


@query("cluster_rollup", f"""WITH {_LINES}, asked(kpi_name) AS (SELECT DISTINCT kpi_name FROM sig UNION ALL VALUES ('no_such_kpi')),
lab AS (SELECT DISTINCT kpi_name, dimension || ' — ' || dimension_value AS l FROM sig),
nl AS (SELECT *, row_number() OVER (PARTITION BY kpi_name ORDER BY lower(l), l) AS rn, count(*) OVER (PARTITION BY kpi_name) AS n FROM lab),
sl AS (SELECT kpi_name, string_agg(l, ', ' ORDER BY rn) || CASE WHEN max(n) > 16 THEN ' (+' || CAST(max(n) - 16 AS VARCHAR) || ' more slices)' ELSE '' END AS s FROM nl WHERE rn <= 16 GROUP BY 1),
wn AS (SELECT kpi_name, period_start, period_end, count(*) AS n, length(string_agg(line, chr(10))) AS chars FROM lines GROUP BY 1, 2, 3),
sc AS (SELECT kpi_name, count(*) AS n FROM sig GROUP BY 1)
SELECT a.kpi_name, 'KPI Portfolio' AS dimension_name, s AS dimension_value,
  CASE WHEN sc.n IS NULL THEN NULL ELSE day(ps) || '-' || day(pe) || ' ' || strftime(ps, '%b') END AS period,
  CASE WHEN sc.n IS NOT NULL THEN ps END AS period_start, CASE WHEN sc.n IS NOT NULL THEN pe END AS period_end, coalesce(sc.n, 0) AS signal_count,
  coalesce(why_n, 0) AS why_count, coalesce(chars, 0) AS why_chars, CASE WHEN sc.n IS NULL THEN 'no signals' WHEN coalesce(chars, 0) > 200000 THEN 'skipped' ELSE 'kept' END AS status
FROM (SELECT asked.kpi_name, coalesce(period_start, DATE '1998-06-22') AS ps, coalesce(period_end, DATE '1998-06-28') AS pe, wn.n AS why_n, chars FROM asked LEFT JOIN wn USING (kpi_name)) a
LEFT JOIN sl ON sl.kpi_name = a.kpi_name LEFT JOIN sc ON sc.kpi_name = a.kpi_name""")
def cluster_rollup(t: Tables) -> DataFrame:
    """One cluster per KPI and window over all slices; a KPI without signals is reported."""
    signals = stored_signals(t)
    kpis = signals.select("kpi_name").distinct().unionByName(
        t.spark.range(1).select(F.lit("no_such_kpi").alias("kpi_name")))
    return cl.rollup_clusters(signals, stored_whys(t, signals), kpis, F.lit(date(1998, 6, 22)), F.lit(date(1998, 6, 28)))


@query("cluster_drivers", f"""WITH {_LINES}, d AS (SELECT DISTINCT ck, cd, CASE WHEN dep_kpi_label <> '' AND dep_kpi_name <> dep_kpi_label
  THEN dep_kpi_label || ' (id=' || dep_kpi_name || ')' ELSE coalesce(dep_kpi_label, dep_kpi_name) END AS x FROM owned WHERE dep_kpi_name IS NOT NULL)
SELECT ck AS kpi_name, cd AS dimension, CAST(count(*) AS BIGINT) AS driver_count, string_agg(x, ', ' ORDER BY x) AS drivers FROM d GROUP BY 1, 2""")
def cluster_drivers(t: Tables) -> DataFrame:
    """Distinct dependent drivers of each cluster."""
    signals = stored_signals(t)
    lines = cl.cluster_lines(signals, stored_whys(t, signals)).drop("kpi_name")
    keyed = lines.withColumnRenamed("cluster_kpi", "kpi_name").withColumnRenamed("cluster_dim", "dimension")
    return cl.driver_line(keyed, ["kpi_name", "dimension"], cl.DRIVER_ITEMS, cl.DRIVER_CHARS)


@query("cluster_slice_summary", f"""WITH {HISTORY}, lab AS (SELECT DISTINCT severity, dimension || ' — ' || dimension_value AS l FROM hist),
nl AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY lower(l), l) AS rn, count(*) OVER (PARTITION BY severity) AS n FROM lab)
SELECT severity, max(n) AS slice_count, string_agg(l, ', ' ORDER BY rn) || CASE WHEN max(n) > 16 THEN ' (+' || CAST(max(n) - 16 AS VARCHAR) || ' more slices)' ELSE '' END AS slice_summary
FROM nl WHERE rn <= 16 GROUP BY 1""")
def cluster_slice_summary(t: Tables) -> DataFrame:
    """First sixteen slices per severity and how many are left out."""
    return cl.slice_summary(signal_history(t), ["severity"])


@query("signal_windows", f"""WITH {WHYS}, w AS (SELECT DISTINCT k, period_start, period_end FROM (
  SELECT signal_id AS k, period_start, period_end FROM why UNION ALL SELECT kpi_name, period_start, period_end FROM why)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY period_start, period_end) AS rn, count(*) OVER (PARTITION BY k) AS n FROM w)
SELECT k, max(n) AS window_count, (SELECT min(period_start) FROM w x WHERE x.k = r.k) AS first_start, (SELECT max(period_end) FROM w x WHERE x.k = r.k) AS last_end,
  CASE WHEN max(n) = 1 THEN string_agg(CAST(period_start AS VARCHAR) || ' to ' || CAST(period_end AS VARCHAR), '; ' ORDER BY rn)
  ELSE 'mixed: ' || string_agg(CAST(period_start AS VARCHAR) || ' to ' || CAST(period_end AS VARCHAR), '; ' ORDER BY rn)
    || CASE WHEN max(n) > 3 THEN '; +' || CAST(max(n) - 3 AS VARCHAR) || ' more' ELSE '' END END AS windows
FROM r WHERE rn <= 3 GROUP BY k""")
def signal_windows(t: Tables) -> DataFrame:
    """Distinct windows of each signal and of each KPI."""
    whys = stored_whys(t, stored_signals(t))
    keyed = whys.select(F.explode(F.array("signal_id", "kpi_name")).alias("k"), "period_start", "period_end")
    return cl.windows_of(keyed, ["k"])


_PAYLOAD_WHY = f"""concat_ws(' | ', why_id, signal_id, coalesce(dep_kpi_label, dep_kpi_name, 'n/a'), dimension_name, dimension_value, coalesce(dep_kpi_name, 'null'),
  {_metric(_DRIVER, 'current_value')}, {_metric(_DRIVER, 'prev_value')}, coalesce(CAST(change_pct AS VARCHAR), 'n/a'), trim(replace(rationale, '|', '/')))"""
_PAYLOAD_SIGNAL = f"""concat_ws(' | ', signal_id, kpi_name, feature_name, {_metric('kpi_name', 'current_kpi_value')}, {_metric('kpi_name', 'prev_kpi_value')},
  {q.trimmed('feature_value')}, coalesce(win, 'n/a'), CASE WHEN current_kpi_value IS NULL OR prev_kpi_value IS NULL THEN 'n/a'
  WHEN current_kpi_value > prev_kpi_value THEN 'up' WHEN current_kpi_value < prev_kpi_value THEN 'down' ELSE 'flat' END)"""


@query("cluster_payload", f"""WITH {WHYS}, pw AS (SELECT signal_id, min(CAST(period_start AS VARCHAR) || ' to ' || CAST(period_end AS VARCHAR)) AS win FROM why GROUP BY 1)
SELECT 'signal' AS kind, signal_id AS row_id, {_PAYLOAD_SIGNAL} AS line FROM sig LEFT JOIN pw USING (signal_id)
UNION ALL SELECT 'why', why_id, {_PAYLOAD_WHY} FROM why""")
def cluster_payload(t: Tables) -> DataFrame:
    """One delimited line per signal and per WHY row."""
    signals = stored_signals(t)
    whys = stored_whys(t, signals)
    one = cl.signal_payload(signals, whys).select(F.lit("signal").alias("kind"), F.col("signal_id").alias("row_id"), "line")
    two = cl.why_payload(whys).select(F.lit("why").alias("kind"), F.col("why_id").alias("row_id"), "line")
    return one.unionByName(two)


@query("cluster_members", f"""WITH {HISTORY} SELECT dimension_value, count(*) AS signal_count, CASE WHEN count(DISTINCT signal_name) = 1 THEN min(signal_name) ELSE left(string_agg(DISTINCT signal_name, ', ' ORDER BY signal_name), 400) END AS canonical
FROM hist WHERE dimension = 'nation' GROUP BY 1""")
def cluster_members(t: Tables) -> DataFrame:
    """Canonical label per slice when the bucket's own value is a placeholder."""
    grouped = signal_history(t).where("dimension = 'nation'").groupBy("dimension_value").agg(
        F.count(F.lit(1)).alias("signal_count"), F.collect_set("signal_name").alias("names"))
    return grouped.select("dimension_value", "signal_count", cl.canonical_member(F.lit("N/A"), F.col("names"), cl.CANONICAL_CHARS).alias("canonical"))


# --- groups -----------------------------------------------------------------------------------


def order_insights(t: Tables) -> DataFrame:
    """An insight-like row per order: KPI lists, period labels and stored tags that follow from its columns."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return t("orders").select(
        key.alias("insight_id"),
        F.when(key % 4 == 0, "order_value").when(key % 4 == 1, " Order_Count , revenue").when(key % 4 == 2, "return_rate,unknown").otherwise("other_kpi").alias("kpi"),
        F.when(key % 3 == 0, "group1").when(key % 3 == 1, " Group 3,group2").alias("group_name"),
        F.when(F.dayofmonth(day) <= 15, "1-30 Apr").when(F.dayofmonth(day) <= 25, " 22-28 Jun").otherwise("other").alias("period"),
        F.concat(F.lit("Order "), "o_orderpriority").alias("title"), F.lit("priority").alias("dimension_name"),
        F.col("o_orderpriority").alias("dimension_value"),
        F.when(key % 10 < 9, F.repeat(F.concat(F.col("o_orderstatus"), F.lit(" moved. ")), (key % 200).cast("int"))).alias("why"),
        F.repeat(F.lit("What happened? "), (key % 90).cast("int")).alias("insight"),
        F.lit(None).cast("string").alias("insight_summary"))


_INS = """ins AS (SELECT o_orderkey AS insight_id, CASE o_orderkey % 4 WHEN 0 THEN 'order_value' WHEN 1 THEN ' Order_Count , revenue' WHEN 2 THEN 'return_rate,unknown' ELSE 'other_kpi' END AS kpi,
  CASE o_orderkey % 3 WHEN 0 THEN 'group1' WHEN 1 THEN ' Group 3,group2' END AS group_name,
  CASE WHEN day(o_orderdate) <= 15 THEN '1-30 Apr' WHEN day(o_orderdate) <= 25 THEN ' 22-28 Jun' ELSE 'other' END AS period,
  o_orderpriority AS dimension_value, CASE WHEN o_orderkey % 10 < 9 THEN repeat(o_orderstatus || ' moved. ', CAST(o_orderkey % 200 AS BIGINT)) END AS why,
  repeat('What happened? ', CAST(o_orderkey % 90 AS BIGINT)) AS insight FROM orders)"""
_TAG = "CASE insight_id % 4 WHEN 0 THEN 'group1,group3' WHEN 1 THEN 'group1,group2' WHEN 2 THEN 'group3' END"


@query("group_tags", f"""WITH {_INS} SELECT insight_id, kpi, CASE WHEN {_TAG} IS NOT NULL THEN {_TAG} ELSE group_name END AS group_name,
  {_TAG} IS NULL AS unmapped, {_TAG} IS NOT NULL AND group_name IS DISTINCT FROM {_TAG} AS changed FROM ins""")
def group_tags(t: Tables) -> DataFrame:
    """Group tags of every insight from the KPIs it names."""
    return gr.tag_groups(order_insights(t), GROUPS).select("insight_id", "kpi", "group_name", "unmapped", "changed")


@query("group_tag_report", f"""WITH {_INS} SELECT count(*) AS scanned, count(CASE WHEN group_name IS NULL AND {_TAG} IS NOT NULL THEN 1 END) AS changed,
  count(CASE WHEN {_TAG} IS NULL THEN 1 END) AS unmapped FROM ins""")
def group_tag_report(t: Tables) -> DataFrame:
    """What a backfill without overwriting would change."""
    return gr.tag_report(gr.tag_groups(order_insights(t), GROUPS, overwrite=False))


@query("group_filter", f"""WITH {_INS} SELECT insight_id, insight_id % 3 = 1 AS tagged, insight_id % 4 IN (0, 2) AS named FROM ins WHERE insight_id % 3 = 1 OR insight_id % 4 IN (0, 2)""")
def group_filter(t: Tables) -> DataFrame:
    """Insights of one group, by stored tag and by KPI name."""
    rows = order_insights(t).select(
        "insight_id", gr.in_group("group_name", "GROUP 3").alias("tagged"), gr.names_any("kpi", GROUPS["group3"]).alias("named"))
    return rows.where("tagged or named")


@query("insight_split", f"""WITH {_INS} SELECT insight_id, CASE WHEN trim(period) = '1-30 Apr' THEN 'monthly' ELSE 'weekly' END AS bucket, FALSE AS fallback FROM ins WHERE trim(period) <> 'other'
UNION ALL SELECT insight_id, CASE WHEN trim(period) = '1-30 Apr' THEN 'monthly' ELSE 'weekly' END, TRUE FROM ins""")
def insight_split(t: Tables) -> DataFrame:
    """Monthly and weekly buckets, by exact label and with the weekly fallback."""
    rows = order_insights(t)
    parts = [gr.split_periods(rows, "1-30 Apr", "22-28 Jun", fallback).select("insight_id", "bucket", F.lit(fallback).alias("fallback"))
             for fallback in (False, True)]
    return parts[0].unionByName(parts[1])


def _clip(x: str, n: int) -> str:
    return f"CASE WHEN length(trim(coalesce({x}, ''))) > {n} THEN left(trim({x}), {n - 1}) || '…' ELSE trim(coalesce({x}, '')) END"


@query("summary_blocks", f"""WITH {_INS}, {SIGNALS} SELECT CAST(insight_id AS VARCHAR) AS row_id, 'Period: ' || trim(period) || chr(10) || 'Title: Order ' || dimension_value || chr(10) || 'KPI: ' || trim(kpi) || chr(10)
  || 'Slice: priority — ' || dimension_value || chr(10) || 'Why: ' || {_clip('why', 1200)} || chr(10) || 'What: ' || {_clip('insight', 600)} || chr(10) || 'Summary: ' || chr(10) AS block FROM ins
UNION ALL SELECT signal_id, 'KPI: ' || kpi_name || chr(10) || 'Signal: ' || signal_name || chr(10) || 'Current: ' || coalesce(CAST(current_kpi_value AS VARCHAR), 'None') || chr(10) || 'Previous: ' || coalesce(CAST(prev_kpi_value AS VARCHAR), 'None')
  || chr(10) || 'Change: ' || coalesce(CASE WHEN x < 0 THEN '' ELSE '+' END || CAST(x AS VARCHAR) || '%', 'n/a') || chr(10) || 'Severity: ' || severity || chr(10)
FROM (SELECT *, round(CAST({q.pct_abs('current_kpi_value', 'prev_kpi_value')} AS DECIMAL(38,6)), 1) AS x FROM sig WHERE dimension <> 'SELF')""")
def summary_blocks(t: Tables) -> DataFrame:
    """Input blocks of a summary: one per insight, one per signal."""
    one = gr.insight_blocks(order_insights(t)).select(F.col("insight_id").cast("string").alias("row_id"), "block")
    two = gr.signal_blocks(base_signals(t).where("dimension <> 'SELF'")).select(F.col("signal_id").alias("row_id"), "block")
    return one.unionByName(two)
