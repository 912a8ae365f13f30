"""KPI queries, ad-hoc fetch, periods, tiles and breakdowns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators import fetch as fx
from ..operators import groups as gr
from ..operators import tiles as ti
from ..operators.query import KpiQuery, keep_members, kpis_long
from ..sources import config as cf
from ..sources.tables import Tables, typed_read
from . import sql as q
from .registry import query
from .retail import APRIL, JOBS, LINES, ORDER_DIMS, ORDERS, QUARTER, STARS, WEEK, YEARS

WITH_OS = f"WITH {q.OS}\n"
WITH_LS = f"WITH {q.LS}\n"


@query("star_scan", f"""{WITH_OS}
SELECT o_orderkey, o_totalprice, o_orderpriority, c_mktsegment, n_name, r_name FROM os WHERE {q.od(q.APRIL)}""")
def star_scan(t: Tables) -> DataFrame:
    return KpiQuery(ORDERS, t, window=APRIL, dims=ORDER_DIMS).filtered().select(
        "o_orderkey", "o_totalprice", "o_orderpriority", "c_mktsegment", "n_name", "r_name")


_CATALOGUE = [(k, s) for s in STARS for k in s.kpis]


def _catalogue_values() -> str:
    rows = []
    for kpi, star in _CATALOGUE:
        for d in star.dims_of(kpi.name):
            deps = f"'{','.join(kpi.depends_on)}'" if kpi.depends_on else "NULL"
            rows.append(f"('{kpi.name}', '{kpi.format}', '{d}', {deps})")
    return ", ".join(rows)


@query("kpi_config_resolve", f"""WITH members AS (
  SELECT 'priority' AS d, count(DISTINCT o_orderpriority) AS n FROM orders UNION ALL
  SELECT 'status', count(DISTINCT o_orderstatus) FROM orders UNION ALL
  SELECT 'segment', count(DISTINCT c_mktsegment) FROM customer UNION ALL
  SELECT 'nation', count(DISTINCT n_name) FROM nation UNION ALL
  SELECT 'region', count(DISTINCT r_name) FROM region UNION ALL
  SELECT 'brand', count(DISTINCT p_brand) FROM part UNION ALL
  SELECT 'part_type', count(DISTINCT p_type) FROM part UNION ALL
  SELECT 'return_flag', count(DISTINCT l_returnflag) FROM lineitem UNION ALL
  SELECT 'line_status', count(DISTINCT l_linestatus) FROM lineitem UNION ALL
  SELECT 'event_type', count(DISTINCT event_type) FROM events),
cfg(kpi_name, format, dimension_name, dependencies) AS (VALUES {_catalogue_values()})
SELECT kpi_name, format, dimension_name, dependencies, n AS member_count
FROM cfg JOIN members ON d = dimension_name""")
def kpi_config_resolve(t: Tables) -> DataFrame:
    """KPI configuration resolved to dimensions and dependencies, with the members each one has in the data."""
    cf.check_catalogue(STARS)
    frames = cf.catalogue_frames(t.spark, STARS)
    resolved = cf.resolve_kpis(frames["kpi"], frames["valid_dimension"], frames["dimension"], frames["dependency"])
    counts = None
    for star in STARS:
        for d in star.dimensions:
            if d.kind != "text":
                continue
            table = star.links[d.via[-1]].table if d.via else star.fact
            one = t(table).agg(F.count_distinct(F.expr(d.expr)).alias("member_count")).select(
                F.lit(d.name).alias("dimension_name"), "member_count")
            counts = one if counts is None else counts.unionByName(one)
    return resolved.join(counts, "dimension_name").select(
        "kpi_name", "format", "dimension_name", "dependencies", "member_count")


_TYPED = {"event_id": "bigint", "value": "double", "flag": "boolean", "day": "date", "note": "string"}


@query("typed_read", """WITH raw AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value,
         CASE WHEN event_type = 'error' THEN 'true' WHEN event_type = 'view' THEN 'false' ELSE 'maybe' END AS flag,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS note FROM events)
SELECT TRY_CAST(event_id AS BIGINT) AS event_id, TRY_CAST(value AS DOUBLE) AS value,
       CASE flag WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS flag, TRY_CAST(day AS DATE) AS day, note
FROM raw""")
def typed_read_events(t: Tables) -> DataFrame:
    """Text columns read back under declared types; unreadable values become NULL."""
    kind = F.col("event_type")
    raw = t("events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("VALUE"),
        F.when(kind == "error", "true").when(kind == "view", "false").otherwise("maybe").alias("flag"),
        F.col("ts").cast("date").cast("string").alias("day"), kind.alias("note"), F.lit("x").alias("unused"),
    )
    return typed_read(raw, _TYPED)


# --- KPI queries ------------------------------------------------------------------------------


@query("kpi_by_dimension", f"""{WITH_OS}
SELECT o_orderpriority AS priority, {q.order_kpi('order_value')} AS kpi_value FROM os
WHERE {q.od(q.APRIL)} GROUP BY 1""")
def kpi_by_dimension(t: Tables) -> DataFrame:
    return KpiQuery(ORDERS, t).with_kpi("order_value").group_by("priority").between(APRIL.start, APRIL.end).ordered()


@query("kpi_by_two_dims", f"""{WITH_OS}
SELECT c_mktsegment AS segment, r_name AS region, {q.order_kpi('avg_order_value')} AS kpi_value FROM os
WHERE {q.od(('1996-01-01', '2000-01-01'))} GROUP BY 1, 2""")
def kpi_by_two_dims(t: Tables) -> DataFrame:
    return KpiQuery(ORDERS, t, window=YEARS).with_kpi("avg_order_value").group_by("segment", "region").to_df()


@query("kpi_single_day", f"""
SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS kpi_value FROM events
WHERE ts >= DATE '2024-01-15' AND ts < DATE '2024-01-16' GROUP BY 1""")
def kpi_single_day(t: Tables) -> DataFrame:
    """A one-day window over timestamps takes the whole day."""
    day = date(2024, 1, 15)
    return KpiQuery(STARS[2], t).with_kpi("event_value").group_by("event_type").between(day, day).to_df()


@query("kpi_member_filter", f"""{WITH_OS}
SELECT r_name AS region, {q.order_kpi('order_count')} AS kpi_value FROM os
WHERE {q.od(('1998-04-01', '1998-07-01'))} AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
def kpi_member_filter(t: Tables) -> DataFrame:
    return (KpiQuery(ORDERS, t, window=QUARTER).with_kpi("order_count").group_by("region")
            .member("segment", ["BUILDING", "MACHINERY"]).to_df())


@query("kpi_member_table_filter", f"""{WITH_OS}
SELECT c_mktsegment AS segment, {q.order_kpi('order_value')} AS kpi_value FROM os
WHERE {q.od(('1996-01-01', '2000-01-01'))} AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
GROUP BY 1""")
def kpi_member_table_filter(t: Tables) -> DataFrame:
    """A member list that is itself a table, applied as a semi join."""
    query_ = KpiQuery(ORDERS, t, window=YEARS, dims=("segment",)).with_kpi("order_value")
    rich = t("customer").where("c_acctbal > 5000").select("c_custkey")
    frame = keep_members(query_.filtered(), ORDERS.dimension("customer_id"), rich)
    return frame.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        ORDERS.kpi("order_value").measure.over().alias("kpi_value"))


@query("kpi_date_member", f"""{WITH_OS}
SELECT CAST(o_orderdate AS DATE) AS order_day, {q.order_kpi('order_value')} AS kpi_value FROM os
WHERE CAST(o_orderdate AS DATE) IN (DATE '1998-04-02', DATE '1998-04-09', DATE '1998-05-01') GROUP BY 1""")
def kpi_date_member(t: Tables) -> DataFrame:
    """ISO texts select days of a timestamp column."""
    return (KpiQuery(ORDERS, t).with_kpi("order_value").group_by("order_day")
            .member("order_day", ["1998-04-02", "1998-04-09T00:00:00", "1998-05-01"]).to_df())


@query("kpi_entity_pin", f"""{WITH_OS}
SELECT o_orderstatus AS status, {q.order_kpi('order_value')} AS kpi_value FROM os
WHERE {q.od(('1998-04-01', '1998-07-01'))} AND r_name = (SELECT min(r_name) FROM region WHERE r_name = 'ASIA')
GROUP BY 1""")
def kpi_entity_pin(t: Tables) -> DataFrame:
    return (KpiQuery(ORDERS, t, window=QUARTER).with_kpi("order_value").group_by("status").pin("region", "ASIA").to_df())


@query("kpi_exclusion", f"""{WITH_OS}
SELECT c_mktsegment AS segment, {q.order_kpi('order_value')} AS kpi_value FROM os
WHERE {q.od(('1998-04-01', '1998-07-01'))} AND (o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '5-LOW'))
GROUP BY 1""")
def kpi_exclusion(t: Tables) -> DataFrame:
    return (KpiQuery(ORDERS, t, window=QUARTER).with_kpi("order_value").group_by("segment")
            .exclude("priority", ["1-URGENT", "5-LOW"]).to_df())


@query("kpi_having", f"""{WITH_LS}
SELECT p_brand AS brand, {q.line_kpi('revenue')} AS kpi_value FROM ls WHERE {q.ld(('1998-04-01', '1998-07-01'))}
GROUP BY 1 HAVING {q.line_kpi('revenue')} BETWEEN 500000 AND 4000000""")
def kpi_having(t: Tables) -> DataFrame:
    return (KpiQuery(LINES, t, window=QUARTER).with_kpi("revenue").group_by("brand")
            .having("between", 500_000, 4_000_000).to_df())


@query("kpi_having_other", f"""{WITH_LS}
SELECT p_brand AS brand, {q.line_kpi('revenue')} AS kpi_value FROM ls WHERE {q.ld(('1998-04-01', '1998-07-01'))}
GROUP BY 1 HAVING {q.line_kpi('return_rate')} > 0.33 AND {q.line_kpi('line_count')} >= 5""")
def kpi_having_other(t: Tables) -> DataFrame:
    """Conditions on KPIs that are computed for the filter and not shown."""
    return (KpiQuery(LINES, t, window=QUARTER).with_kpi("revenue").group_by("brand")
            .having("gt", 0.33, kpi="return_rate").having("gte", 5, kpi="line_count").to_df())


@query("kpi_self_total", f"""{WITH_OS}
SELECT {q.order_kpi('order_value')} AS order_value, {q.order_kpi('customers')} AS customers FROM os
WHERE {q.od(q.APRIL)}""")
def kpi_self_total(t: Tables) -> DataFrame:
    return KpiQuery(ORDERS, t, window=APRIL).with_kpi("order_value", "order_value").with_kpi("customers", "customers").to_df()


def _long(select: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{k}' AS kpi_name, dimension, dimension_value, {c} AS kpi_value FROM g WHERE {c} IS NOT NULL"
        for k, c in select.items())


_FAN = ", ".join(f"{q.order_kpi(k)} AS {k}" for k in ("order_value", "order_count", "avg_order_value", "customers"))


@query("kpi_all_dimensions", f"""{WITH_OS}, g AS (
{q.by_each('os', q.ORDER_COLUMNS, _FAN, q.od(('1998-04-01', '1998-07-01')), self_total=True)})
{_long({k: k for k in ('order_value', 'order_count', 'avg_order_value', 'customers')})}""")
def kpi_all_dimensions(t: Tables) -> DataFrame:
    """Four KPIs by all five dimensions and in total, from one scan and one shuffle."""
    return kpis_long(ORDERS, t, ["order_value", "order_count", "avg_order_value", "customers"],
                     [*ORDER_DIMS, "SELF"], QUARTER)


@query("kpi_line_dimensions", f"""{WITH_LS}, g AS (
{q.by_each('ls', q.LINE_COLUMNS, ', '.join(f"{q.line_kpi(k)} AS {k}" for k in ('revenue', 'quantity', 'avg_discount')), q.ld(('1996-01-01', '2000-01-01')))})
{_long({k: k for k in ('revenue', 'quantity', 'avg_discount')})}""")
def kpi_line_dimensions(t: Tables) -> DataFrame:
    return kpis_long(LINES, t, ["revenue", "quantity", "avg_discount"], list(q.LINE_COLUMNS), YEARS)


# --- ad-hoc fetch -----------------------------------------------------------------------------

_FETCHED = ", ".join(f"{q.line_kpi(k)} AS {k}" for k in ("revenue", "quantity", "return_rate"))


@query("fetch_multi_kpi", f"""{WITH_LS}
SELECT p_brand AS brand, l_linestatus AS line_status, {_FETCHED} FROM ls
WHERE {q.ld(('1998-04-01', '1998-07-01'))} AND l_returnflag IN ('A', 'R') GROUP BY 1, 2""")
def fetch_multi_kpi(t: Tables) -> DataFrame:
    return fx.fetch(LINES, t, ["revenue", "quantity", "return_rate"], ["brand", "SELF", "line_status"], QUARTER,
                    {"return_flag": ["A", " R ", ""]})


@query("fetch_kpi_condition", f"""{WITH_LS}
SELECT p_brand AS brand, {q.line_kpi('revenue')} AS revenue FROM ls WHERE {q.ld(('1998-04-01', '1998-07-01'))}
GROUP BY 1 HAVING {q.line_kpi('quantity')} BETWEEN 100 AND 100000 AND {q.line_kpi('line_count')} >= 3
  AND {q.line_kpi('revenue')} > 100000 AND {q.line_kpi('revenue')} <> 0""")
def fetch_kpi_condition(t: Tables) -> DataFrame:
    return fx.fetch(LINES, t, ["revenue"], ["brand"], QUARTER,
                    {"quantity": "between 100 and 100000", "line_count": {"op": ">=", "value": 3}},
                    having=["> 100000", "<> 0"])


@query("fetch_long", f"""{WITH_LS}, w AS (SELECT p_type AS part_type, {_FETCHED} FROM ls
WHERE {q.ld(('1998-04-01', '1998-07-01'))} GROUP BY 1)
SELECT part_type, kpi_name, kpi_value, count(*) OVER (PARTITION BY kpi_name) AS row_count FROM (
  SELECT part_type, 'revenue' AS kpi_name, revenue AS kpi_value FROM w UNION ALL
  SELECT part_type, 'quantity', quantity FROM w UNION ALL SELECT part_type, 'return_rate', return_rate FROM w)""")
def fetch_long(t: Tables) -> DataFrame:
    return fx.fetch_long(LINES, t, ["revenue", "quantity", "return_rate"], ["part_type"], QUARTER)


_CMP = ["order_value", "avg_order_value", "customers"]
_CMP_DIR = "CASE WHEN c IS NULL OR p IS NULL THEN 'flat' WHEN c > p THEN 'up' WHEN c < p THEN 'down' ELSE 'flat' END"


@query("fetch_compare_previous", f"""{WITH_OS}, x AS (
{" UNION ALL ".join(f"SELECT '{k}' AS kpi_name, {q.order_kpi(k, q.od(q.APRIL))} AS c, {q.order_kpi(k, q.od(('1998-03-02', '1998-04-01')))} AS p FROM os WHERE c_mktsegment <> 'none'" for k in _CMP)})
SELECT kpi_name, c AS current_value, p AS previous_value, c - p AS delta, {q.pct('c', 'p')} AS pct_change,
       {_CMP_DIR} AS direction FROM x""")
def fetch_compare_previous(t: Tables) -> DataFrame:
    return fx.compare_previous(ORDERS, t, _CMP, APRIL, ["segment"])


@query("fetch_compare_filtered", f"""{WITH_OS}, g AS (
SELECT n_name, {q.order_kpi('order_value', q.od(q.APRIL))} AS c, {q.order_kpi('order_value', q.od(('1998-03-02', '1998-04-01')))} AS p
FROM os GROUP BY 1), x AS (
SELECT CAST(sum(CASE WHEN c > 500000 THEN CAST(c AS DECIMAL(28,4)) END) AS DOUBLE) AS c,
       CAST(sum(CASE WHEN p > 500000 THEN CAST(p AS DECIMAL(28,4)) END) AS DOUBLE) AS p FROM g)
SELECT 'order_value' AS kpi_name, c AS current_value, p AS previous_value, c - p AS delta,
       {q.pct('c', 'p')} AS pct_change, {_CMP_DIR} AS direction FROM x""")
def fetch_compare_filtered(t: Tables) -> DataFrame:
    """With a value condition the totals are those of the groups that pass in each window."""
    return fx.compare_previous(ORDERS, t, ["order_value"], APRIL, ["nation"], {"order_value": "> 500000"})


@query("distinct_members", f"""{WITH_OS}
SELECT DISTINCT dimension, dimension_value FROM (
  SELECT 'nation' AS dimension, trim(n_name) AS dimension_value FROM os WHERE {q.od(q.APRIL)} AND o_orderstatus = 'F' UNION ALL
  SELECT 'segment', trim(c_mktsegment) FROM os WHERE {q.od(q.APRIL)} AND o_orderstatus = 'F')
WHERE dimension_value <> ''""")
def distinct_members(t: Tables) -> DataFrame:
    return fx.distinct_members(ORDERS, t, ["nation", "segment", "Nation"], APRIL, {"status": "F"})


@query("fetch_week", f"""{WITH_OS}, w AS (
SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, {q.order_kpi('order_value')} AS order_value FROM os
WHERE {q.od(('1998-01-01', '1999-01-01'))} GROUP BY 1)
SELECT week, order_value, CAST(isoyear(week) * 100 + weekofyear(week) AS INTEGER) AS week_sort, week AS week_start,
       CAST(week + INTERVAL 6 DAY AS DATE) AS week_end FROM w""")
def fetch_week(t: Tables) -> DataFrame:
    year = P.Window(date(1998, 1, 1), date(1998, 12, 31))
    return fx.week_columns(fx.fetch(ORDERS, t, ["order_value"], ["week"], year))


# --- periods ----------------------------------------------------------------------------------

_FEATURES = ["wow_growth_pct", "wom_growth_pct", "mom_growth_pct", "qoq_growth_pct", "yoy_growth_pct", "acceleration",
             "kpi_vs_rolling_avg_pct", "rolling_avg", "rolling_avg_6m", "rolling_avg_12m", "std_dev", "std_dev_3m",
             "growth_pct", "rank"]


def _prior_sql() -> str:
    def back(n: int) -> str:
        return f"s - {n}"

    def mon(x: str, n: int) -> str:
        return f"CAST({x} - INTERVAL {n} MONTH AS DATE)"

    cases = {
        "wow_growth_pct": (back(7), "s - 1"), "wom_growth_pct": (back(7), "s - 1"),
        "mom_growth_pct": (mon("s", 1), mon("e", 1)), "qoq_growth_pct": (mon("s", 3), mon("e", 3)),
        "yoy_growth_pct": (mon("s", 12), mon("e", 12)),
        "acceleration": (f"CASE WHEN e - s + 1 <= 14 THEN s - 7 ELSE {mon('s', 1)} END", "s - 1"),
        "kpi_vs_rolling_avg_pct": (mon("s", 3), "s - 1"), "rolling_avg": (mon("s", 3), "s - 1"),
        "rolling_avg_6m": (mon("s", 6), "s - 1"), "rolling_avg_12m": (mon("s", 12), "s - 1"),
        "std_dev": (mon("s", 6), "s - 1"), "std_dev_3m": (mon("s", 3), "s - 1"),
        "growth_pct": (f"CASE WHEN e - s + 1 <= 14 THEN s - CAST(e - s + 1 AS INTEGER) ELSE {mon('s', 1)} END",
                       f"CASE WHEN e - s + 1 <= 14 THEN s - 1 ELSE {mon('e', 1)} END"),
        "rank": ("s - CAST(e - s + 1 AS INTEGER)", "s - 1"),
    }
    return "\nUNION ALL\n".join(
        f"SELECT k AS window_key, s AS period_start, e AS period_end, '{f}' AS feature_name, "
        f"CAST({a} AS DATE) AS prior_start, CAST({b} AS DATE) AS prior_end FROM w" for f, (a, b) in cases.items())


def _order_windows(t: Tables) -> DataFrame:
    """One window per order: from its day to a day that depends on its customer."""
    start = F.col("o_orderdate").cast("date")
    return t("orders").select(
        F.col("o_orderkey").alias("window_key"), start.alias("period_start"),
        F.date_add(start, (F.col("o_custkey") % 120).cast("int")).alias("period_end"))


_WINDOWS_CTE = ("w AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, "
                "CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 AS INTEGER) AS e FROM orders)")


@query("prior_windows", f"WITH {_WINDOWS_CTE}\n{_prior_sql()}")
def prior_windows(t: Tables) -> DataFrame:
    """Comparison windows of every feature, for a whole table of windows."""
    frame = _order_windows(t).withColumn("feature_name", F.explode(F.array(*[F.lit(f) for f in _FEATURES])))
    start, end = P.prior_window_columns(F.col("feature_name"), F.col("period_start"), F.col("period_end"))
    return frame.withColumns({"prior_start": start, "prior_end": end})


@query("week_window", """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
  CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE) AS week_end FROM orders""")
def week_window(t: Tables) -> DataFrame:
    first = P.week_start(F.col("o_orderdate"))
    return t("orders").select("o_orderkey", first.alias("week_start"), F.date_add(first, 6).alias("week_end"))


@query("period_from_text", f"""WITH {_WINDOWS_CTE}
SELECT k AS window_key, s AS period_start, e AS period_end FROM w WHERE k % 11 <> 3
UNION ALL SELECT k, NULL, NULL FROM w WHERE k % 11 = 3""")
def period_from_text(t: Tables) -> DataFrame:
    """Windows recovered from stored query texts, some reversed and some without any."""
    rows = _order_windows(t)
    start, end, key = F.col("period_start"), F.col("period_end"), F.col("window_key")
    stored = (
        F.when(key % 11 == 3, "EVALUATE no window here")
        .when(key % 5 == 0, F.concat(F.lit("x "), P.window_text(end, start), F.lit(" CALENDAR(DATE(1990,1,1),DATE(1990,1,2))")))
        .otherwise(F.concat(F.lit("EVALUATE "), P.window_text(start, end)))
    )
    found = P.window_from_text(F.col("stored"))
    return rows.select("window_key", stored.alias("stored")).select(
        "window_key", found[0].alias("period_start"), found[1].alias("period_end"))


@query("period_labels", f"""WITH {_WINDOWS_CTE}
SELECT k AS window_key,
  CASE WHEN year(s) = year(e) AND month(s) = month(e) THEN day(s) || '-' || day(e) || ' ' || strftime(s, '%b')
       WHEN year(s) = year(e) THEN day(s) || ' ' || strftime(s, '%b') || '–' || day(e) || ' ' || strftime(e, '%b') || ' ' || year(e)
       ELSE CAST(s AS VARCHAR) || '–' || CAST(e AS VARCHAR) END AS label FROM w""")
def period_labels(t: Tables) -> DataFrame:
    return _order_windows(t).select(
        "window_key", P.period_label(F.col("period_start"), F.col("period_end")).alias("label"))


@query("acceleration_grains", f"""WITH {_WINDOWS_CTE}
SELECT k AS window_key, CASE WHEN e - s + 1 <= 14 THEN 'wow_growth_pct' WHEN e - s + 1 <= 95 THEN 'mom_growth_pct'
  WHEN e - s + 1 <= 100 THEN 'qoq_growth_pct' ELSE 'yoy_growth_pct' END AS grain FROM w""")
def acceleration_grains(t: Tables) -> DataFrame:
    days = F.datediff("period_end", "period_start") + 1
    return _order_windows(t).select("window_key", P.acceleration_grain_column(days).alias("grain"))


def _labelled_windows(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    month = F.trunc(day, "month")
    return t("orders").select(
        F.col("o_orderkey").alias("insight_id"),
        F.concat(F.lit(" "), P.period_label(month, F.last_day(month)), F.lit(" ")).alias("period"),
        day.alias("period_start"), F.date_add(day, 3).alias("period_end"))


@query("window_from_rows", """SELECT '1-30 Apr' AS period, min(CAST(o_orderdate AS DATE)) AS period_start,
  CAST(max(CAST(o_orderdate AS DATE)) + 3 AS DATE) AS period_end, 'stored' AS source FROM orders WHERE month(o_orderdate) = 4
UNION ALL SELECT '22-28 Jun', DATE '1998-06-22', DATE '1998-06-28', 'default'""")
def window_from_rows(t: Tables) -> DataFrame:
    """Window of a label from the rows that carry it, else a configured default."""
    rows = _labelled_windows(t)
    start, end = F.lit(date(1998, 6, 22)), F.lit(date(1998, 6, 28))
    parts = [gr.window_or_default(gr.window_from_rows(rows, label), label, start, end)
             for label in ("1-30 Apr", "22-28 Jun")]
    return parts[0].unionByName(parts[1])


# --- tiles ------------------------------------------------------------------------------------


def _tile_sql(base: str, kpis: dict[str, tuple[str, str, str]], grain: str) -> str:
    """`kpis`: name to (kind, value now, value before)."""
    parts = [f"SELECT '{k}' AS kpi_name, '{kind}' AS kind, {c} AS v, {p} AS b FROM {base}" for k, (kind, c, p) in kpis.items()]
    return f"""x AS ({' UNION ALL '.join(parts)}),
y AS (SELECT *, CASE WHEN kind = 'points' THEN round({q.scale100('v')} - {q.scale100('b')}, 2)
  WHEN kind = 'percentage' THEN round({q.pct_abs(q.scale100('v'), q.scale100('b'))}, 1)
  ELSE round({q.pct_abs('v', 'b')}, 1) END AS change FROM x),
z AS (SELECT kpi_name, v AS value, b AS previous_value, change,
  CASE WHEN change IS NULL THEN NULL WHEN kind = 'points' THEN 'percentage_points' ELSE 'percent' END AS change_unit,
  CASE WHEN v IS NULL THEN NULL WHEN b IS NULL THEN 'No previous {grain} value available'
    WHEN change IS NULL THEN 'Previous {grain} value was zero'
    WHEN abs(change) < 0.05 THEN 'Unchanged from previous {grain}'
    ELSE {q.trimmed('abs(change)')} || CASE WHEN kind = 'points' THEN ' pp' ELSE '%' END
      || CASE WHEN change > 0 THEN ' increase' ELSE ' decrease' END || ' from previous {grain}' END AS comparison_text
  FROM y)"""


_ORDER_TILES = ("order_value", "order_count", "avg_order_value", "finished_rate", "customers")
_KINDS = {"finished_rate": "points", "return_rate": "points", "avg_discount": "percentage"}


def _order_tiles(now: tuple[str, str], before: tuple[str, str], extra: str = "TRUE", kpis=_ORDER_TILES) -> dict:
    return {k: (_KINDS.get(k, "number"), q.order_kpi(k, f"{q.od(now)} AND {extra}"),
                q.order_kpi(k, f"{q.od(before)} AND {extra}")) for k in kpis}


@query("tiles_month", f"WITH {q.OS}, {_tile_sql('os', _order_tiles(q.APRIL, q.MARCH_30), 'month')} SELECT * FROM z")
def tiles_month(t: Tables) -> DataFrame:
    return ti.tiles(ORDERS, t, _ORDER_TILES, APRIL)


@query("tiles_week", f"WITH {q.OS}, {_tile_sql('os', _order_tiles(q.WEEK, q.WEEK_BEFORE), 'week')} SELECT * FROM z")
def tiles_week(t: Tables) -> DataFrame:
    return ti.tiles(ORDERS, t, _ORDER_TILES, WEEK, "week")


_LINE_TILES = {k: (_KINDS.get(k, "number"), q.line_kpi(k, q.ld(q.APRIL)), q.line_kpi(k, q.ld(q.MARCH_30)))
               for k in ("revenue", "quantity", "avg_discount", "return_rate")}


@query("tiles_text", f"""WITH {q.LS}, {_tile_sql('ls', _LINE_TILES, 'month')}
SELECT *, CAST(NULL AS VARCHAR) AS error FROM z WHERE kpi_name <> 'quantity'
UNION ALL SELECT 'profit', NULL, NULL, NULL, NULL, NULL, 'KPI ''profit'' not found'""")
def tiles_text(t: Tables) -> DataFrame:
    """Requested tiles: an unknown KPI becomes an error row and the others are still computed."""
    rows = ti.tiles(LINES, t, ["revenue", "avg_discount", "return_rate"], APRIL)
    return ti.requested_tiles(t.spark, LINES, rows, ["revenue", "profit", "avg_discount", "return_rate"])


@query("tiles_sliced", f"""WITH {q.OS}, {_tile_sql('os', _order_tiles(q.APRIL, q.MARCH_30, "c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_orderstatus = 'O'", ('order_value', 'order_count')), 'month')} SELECT * FROM z""")
def tiles_sliced(t: Tables) -> DataFrame:
    return ti.tiles(ORDERS, t, ["order_value", "order_count"], APRIL,
                    slices={"segment": "BUILDING, MACHINERY,,BUILDING", "status": ["O"], "region": " "})


@query("tiles_two_windows", f"""SELECT 'monthly' AS "window", * FROM (WITH {q.OS}, {_tile_sql('os', _order_tiles(q.APRIL, q.MARCH_30), 'month')} SELECT * FROM z)
UNION ALL SELECT 'weekly', * FROM (WITH {q.OS}, {_tile_sql('os', _order_tiles(q.WEEK, q.WEEK_BEFORE), 'week')} SELECT * FROM z)""")
def tiles_two_windows(t: Tables) -> DataFrame:
    return ti.tile_windows(ORDERS, t, _ORDER_TILES, {"monthly": ("month", APRIL), "weekly": ("week", WEEK)})


_BREAK = ", ".join(f"{q.order_kpi(k)} AS {k}" for k in ("order_value", "finished_rate"))


def _breakdown_sql(span: tuple[str, str]) -> str:
    inner = q.by_each("os", q.ORDER_COLUMNS, _BREAK, q.od(span))
    return "\nUNION ALL\n".join(
        f"SELECT '{k}' AS kpi_name, dimension, trim(dimension_value) AS dimension_value, {k} AS value "
        f"FROM ({inner}) WHERE trim(dimension_value) <> '' AND {k} IS NOT NULL" for k in ("order_value", "finished_rate"))


@query("kpi_breakdown", f"{WITH_OS}{_breakdown_sql(q.APRIL)}")
def kpi_breakdown(t: Tables) -> DataFrame:
    return ti.breakdown(ORDERS, t, ["order_value", "finished_rate"], ORDER_DIMS, APRIL)


@query("kpi_breakdown_two_windows", f"""{WITH_OS}SELECT 'monthly' AS "window", * FROM ({_breakdown_sql(q.APRIL)})
UNION ALL SELECT 'weekly', * FROM ({_breakdown_sql(q.WEEK)})""")
def kpi_breakdown_two_windows(t: Tables) -> DataFrame:
    return ti.breakdown_windows(ORDERS, t, ["order_value", "finished_rate"], ORDER_DIMS,
                                {"monthly": APRIL, "weekly": WEEK})


def _insight_sql(parent: str, columns: dict[str, str]) -> str:
    select = ", ".join(f"{q.order_kpi(k, q.od(s))} AS {k}_{n}" for k in ("order_value", "finished_rate")
                       for n, s in (("v", q.APRIL), ("b", q.MARCH_30)))
    grouped = q.by_each("os", columns, select, f"{parent} AND ({q.od(q.APRIL)} OR {q.od(q.MARCH_30)})")
    x = " UNION ALL ".join(
        f"SELECT dimension, trim(dimension_value) AS dimension_value, '{k}' AS kpi_name, '{kind}' AS kind, {k}_v AS v, {k}_b AS b FROM g"
        for k, kind in (("order_value", "number"), ("finished_rate", "points")))
    tail = _tile_sql("g", {"a": ("number", "1.0::DOUBLE", "1.0::DOUBLE")}, "month").split("),\ny AS", 1)[1]
    tail = tail.replace("SELECT kpi_name, v AS value", "SELECT dimension, dimension_value, kpi_name, v AS value")
    return f"WITH {q.OS}, g AS ({grouped}), x AS ({x}),\ny AS{tail} SELECT * FROM z WHERE dimension_value <> '' AND (value IS NOT NULL OR previous_value IS NOT NULL)"


@query("insight_breakdown", _insight_sql("c_mktsegment = 'BUILDING'", q.pick(q.ORDER_COLUMNS, "priority", "status", "nation", "region")))
def insight_breakdown(t: Tables) -> DataFrame:
    return ti.insight_breakdown(ORDERS, t, ["order_value", "finished_rate"], ORDER_DIMS, APRIL, "segment", "BUILDING")


@query("insight_breakdown_portfolio", _insight_sql("TRUE", q.ORDER_COLUMNS))
def insight_breakdown_portfolio(t: Tables) -> DataFrame:
    return ti.insight_breakdown(ORDERS, t, ["order_value", "finished_rate"], ORDER_DIMS, APRIL, "KPI Portfolio", None)
