"""Jobs, thresholds, signals and WHY analysis."""

from __future__ import annotations

from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import signals as sg
from ..operators import why as wy
from ..operators.snapshot import snapshot
from ..sources import config as cf
from ..sources.keyed import KeyedTable
from ..sources.stage import settled, stage_root
from ..sources.tables import Tables
from ..streaming.sweep import explain_new_signals, ledger_rows
from . import run
from . import sql as q
from .registry import query
from .retail import APRIL, DEFINITIONS, JOBS, LINES, ORDERS, STARS, WEEK

RUN_AT = datetime(1998, 5, 1, 6, 0)
SIGNAL_DIMS = ("priority", "segment", "region")
SIGNAL_KPIS = ("order_value", "order_count")

BASE_JOBS = (
    cf.Job(1, "order_value", SIGNAL_DIMS, ("monthly_growth", "monthly_degrowth", "band", "no_upper", "odd_op")),
    cf.Job(3, "order_count", ("priority", "region", "SELF"), ("monthly_growth", "monthly_degrowth", "yearly_growth")),
    cf.Job(7, "order_value", ("segment",), ("week_spike",), period_start=WEEK.start, period_end=WEEK.end),
)


def base_signals(t: Tables) -> DataFrame:
    """Signals of three jobs over two windows."""
    return sg.detect_jobs(t.spark, [ORDERS], t, BASE_JOBS, DEFINITIONS, APRIL, F.lit(RUN_AT))


def stored_signals(t: Tables) -> DataFrame:
    """The same, written once: explanation and clusters read signals many times."""
    return settled(base_signals(t))


def stored_whys(t: Tables, signals: DataFrame) -> DataFrame:
    return settled(base_whys(t, signals))


def base_whys(t: Tables, signals: DataFrame | None = None) -> DataFrame:
    """WHY rows of both windows."""
    signals = stored_signals(t) if signals is None else signals
    monthly = wy.explain(signals, ORDERS, t, SIGNAL_KPIS, SIGNAL_DIMS, APRIL, ["mom_growth_pct", "yoy_growth_pct"], F.lit(RUN_AT))
    weekly = wy.explain(signals, ORDERS, t, ["order_value"], ["segment"], WEEK, ["wow_growth_pct"], F.lit(RUN_AT))
    return monthly.unionByName(weekly)


# --- the same in SQL --------------------------------------------------------------------------

_DEFS = """defs(signal_name, feature_name, operator, threshold, threshold2, severity, top_n) AS (VALUES
  ('monthly_growth', 'mom_growth_pct', 'gt', 10.0::DOUBLE, NULL::DOUBLE, 'info', 3), ('monthly_degrowth', 'mom_growth_pct', 'lt', -10.0, NULL, 'warning', 2),
  ('band', 'mom_growth_pct', 'between', -2.0, 2.0, 'info', NULL), ('no_upper', 'mom_growth_pct', 'between', 5.0, NULL, 'info', NULL),
  ('odd_op', 'mom_growth_pct', 'xx', 0.0, NULL, 'info', NULL), ('yearly_growth', 'yoy_growth_pct', 'gte', 5.0, NULL, 'info', NULL),
  ('weekly_growth', 'wow_growth_pct', 'gt', 5.0, NULL, 'info', NULL))"""

_FIRES = """((operator = 'gt' AND {v} > {a}) OR (operator = 'lt' AND {v} < {a}) OR (operator = 'gte' AND {v} >= {a})
  OR (operator = 'lte' AND {v} <= {a}) OR (operator = 'between' AND {v} BETWEEN {a} AND {b}))"""


def fires(v: str, a: str = "threshold", b: str = "threshold2") -> str:
    return _FIRES.format(v=v, a=a, b=b)


_SPANS = {"mom_growth_pct": (q.APRIL, q.MARCH_30), "yoy_growth_pct": (q.APRIL, q.APRIL_97), "wow_growth_pct": (q.WEEK, ("1998-03-30", "1998-04-06"))}


def _values_sql() -> str:
    """Feature values of both KPIs by three dimensions and in total, from plain grouped queries."""
    dims = q.pick(q.ORDER_COLUMNS, *SIGNAL_DIMS)
    parts = []
    for feature, (now, before) in _SPANS.items():
        for kpi in SIGNAL_KPIS:
            inner = q.by_each("os", dims, f"{q.order_kpi(kpi, q.od(now))} AS c, {q.order_kpi(kpi, q.od(before))} AS p", self_total=True)
            parts.append(f"SELECT '{kpi}' AS kpi_name, dimension, dimension_value, '{feature}' AS feature_name, "
                         f"c AS kpi_value, p AS prior_value, round({q.pct_abs('c', 'p')}, 2) AS feature_value FROM ({inner})")
    return "vals AS (" + "\nUNION ALL\n".join(parts) + ")"


_JOBS = """jobs(job_id, kpi_name, dimension, signal_name) AS (
  SELECT 1, 'order_value', d, s FROM (VALUES ('priority'), ('segment'), ('region')) x(d), (VALUES ('monthly_growth'), ('monthly_degrowth'), ('band'), ('no_upper'), ('odd_op')) y(s)
  UNION ALL SELECT 3, 'order_count', d, s FROM (VALUES ('priority'), ('region'), ('SELF')) x(d), (VALUES ('monthly_growth'), ('monthly_degrowth'), ('yearly_growth')) y(s)
  UNION ALL SELECT 7, 'order_value', 'segment', 'weekly_growth')"""

_SIG = f"""sig AS (
  SELECT sha256(concat_ws('|', CAST(job_id AS VARCHAR), kpi_name, dimension, dimension_value, signal_name, feature_name,
      CAST(period_start AS VARCHAR), CAST(period_end AS VARCHAR))) AS signal_id, * FROM (
  SELECT v.kpi_name, v.dimension, v.dimension_value, d.signal_name, v.feature_name, v.feature_value,
    round(kpi_value, 2) AS current_kpi_value, round(prior_value, 2) AS prev_kpi_value, v.feature_value AS observed_value,
    threshold AS threshold_value, threshold2, operator, severity, round(v.feature_value - threshold, 2) AS breach_delta, job_id,
    CASE WHEN v.feature_name = 'wow_growth_pct' THEN DATE '1998-04-06' ELSE DATE '1998-04-01' END AS period_start,
    CASE WHEN v.feature_name = 'wow_growth_pct' THEN DATE '1998-04-12' ELSE DATE '1998-04-30' END AS period_end, top_n
  FROM vals v JOIN defs d ON v.feature_name = d.feature_name
  JOIN jobs j ON j.kpi_name = v.kpi_name AND j.dimension = v.dimension AND j.signal_name = d.signal_name
  WHERE v.feature_value IS NOT NULL AND v.kpi_value IS NOT NULL AND {fires('v.feature_value')}))"""

SIGNALS = f"{q.OS}, {_values_sql()}, {_DEFS}, {_JOBS}, {_SIG}"

def _drill_sql() -> str:
    """Both routes with one grouped query per signal dimension, drilled dimension, KPI and feature."""
    parts = []
    for feature, (now, before) in _SPANS.items():
        for own in SIGNAL_DIMS:
            a = q.ORDER_COLUMNS[own]
            for kpi in (*SIGNAL_KPIS, "avg_order_value"):
                pair = f"{q.order_kpi(kpi, q.od(now))} AS c, {q.order_kpi(kpi, q.od(before))} AS p"
                head = f"'{kpi}' AS kpi_name, '{own}' AS dimension, {a} AS dimension_value, '{feature}' AS feature_name, {pair}"
                parts.append(f"SELECT {head}, NULL AS drill_dimension, NULL AS drill_value FROM os GROUP BY {a}")
                if kpi == "avg_order_value":
                    continue
                for other, b in q.ORDER_COLUMNS.items():
                    if other != own:
                        parts.append(f"SELECT {head}, '{other}' AS drill_dimension, {b} AS drill_value FROM os GROUP BY {a}, {b}")
    return "drill AS (SELECT *, round(" + q.pct_abs("c", "p") + ", 2) AS change_pct FROM (" + "\nUNION ALL\n".join(parts) + "))"


_WHY = f"""deps(parent_kpi, dependent_kpi) AS (VALUES ('order_value', 'order_count'), ('order_value', 'avg_order_value')),
legs AS (
  SELECT s.signal_id, s.kpi_name, d.drill_dimension AS dimension_name, d.drill_value AS dimension_value, s.signal_name,
    CAST(NULL AS VARCHAR) AS dep_kpi_name, CAST(NULL AS VARCHAR) AS dep_kpi_label, 'Cross-dimension ' || d.drill_dimension AS subject,
    d.c, d.p, d.change_pct, s.period_start, s.period_end
  FROM sig s JOIN drill d ON s.kpi_name = d.kpi_name AND s.dimension = d.dimension AND s.dimension_value = d.dimension_value
    AND s.feature_name = d.feature_name
  WHERE d.drill_dimension IS NOT NULL AND d.c IS NOT NULL AND d.change_pct IS NOT NULL AND {fires('d.change_pct', 's.threshold_value', 's.threshold2').replace('operator', 's.operator')}
  UNION ALL
  SELECT s.signal_id, s.kpi_name, s.dimension, s.dimension_value, s.signal_name, e.dependent_kpi,
    s.kpi_name || ' by ' || s.dimension, 'Dependent KPI ' || e.dependent_kpi, d.c, d.p, d.change_pct, s.period_start, s.period_end
  FROM sig s JOIN deps e ON s.kpi_name = e.parent_kpi JOIN drill d ON d.kpi_name = e.dependent_kpi AND s.dimension = d.dimension
    AND s.dimension_value = d.dimension_value AND s.feature_name = d.feature_name
  WHERE d.drill_dimension IS NULL AND d.c IS NOT NULL AND d.change_pct IS NOT NULL AND {fires('d.change_pct', 's.threshold_value', 's.threshold2').replace('operator', 's.operator')}),
why AS (SELECT sha256(concat_ws('|', signal_id, coalesce(dep_kpi_name, ''), dimension_name, dimension_value)) AS why_id, signal_id, kpi_name,
    dimension_name, dimension_value, signal_name, dep_kpi_name, dep_kpi_label,
    subject || ' ' || dimension_value || CASE WHEN change_pct > 0 THEN ' increased by ' ELSE ' decreased by ' END
      || CAST(round(CAST(abs(change_pct) AS DECIMAL(18,2)), 1) AS VARCHAR) || '%' AS rationale,
    round(c, 2) AS current_value, round(p, 2) AS prev_value, change_pct,
    CAST(period_start AS VARCHAR) || ' to ' || CAST(period_end AS VARCHAR) AS period, period_start, period_end FROM legs)"""

WHYS = f"{SIGNALS}, {_drill_sql()}, {_WHY}"

SIGNAL_COLUMNS = ("signal_id", "kpi_name", "dimension", "dimension_value", "signal_name", "feature_name", "feature_value",
                  "current_kpi_value", "prev_kpi_value", "observed_value", "threshold_value", "operator", "severity",
                  "breach_delta", "job_id", "period_start", "period_end")
WHY_SHOWN = tuple(c for c in wy.WHY_COLUMNS if c != "run_timestamp")
_S = ", ".join(SIGNAL_COLUMNS)
_W = ", ".join(WHY_SHOWN)


# --- jobs and thresholds ----------------------------------------------------------------------


def segment_jobs(t: Tables) -> DataFrame:
    """A job table made from the data: one job per segment and status, with filters as JSON text."""
    grouped = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "o_orderstatus").agg(
            F.min("o_custkey").alias("first"), F.min("o_orderdate").cast("date").cast("string").alias("a"),
            F.max("o_orderdate").cast("date").cast("string").alias("b"), F.count(F.lit(1)).alias("n"))
    )
    bad = F.col("o_orderstatus") == "P"
    text = F.concat(
        F.lit('{"segment": "'), F.col("c_mktsegment"), F.lit('", "status": ["'), F.col("o_orderstatus"),
        F.lit('", "X"], "period": {"start": "'), F.when(bad, "someday").otherwise(F.col("a")),
        F.lit('", "end": "'), F.col("b"), F.lit('"}}'))
    return grouped.select(
        F.concat_ws("/", "c_mktsegment", "o_orderstatus").alias("job_id"),
        F.when(F.col("n") % 2 == 0, "order_value").otherwise("order_count").alias("kpi_name"),
        F.when(bad, F.array().cast("array<string>")).otherwise(F.array(F.lit("priority"), F.lit("region"))).alias("dimensions"),
        F.array(F.lit("week_spike"), F.lit(" weekly_growth"), F.lit(""), F.lit("band")).alias("signals"),
        text.alias("raw_filters"), (F.col("c_mktsegment") != "MACHINERY").alias("is_active"))


_SEGMENT_JOBS = """seg AS (SELECT c_mktsegment AS m, o_orderstatus AS st, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS a,
  max(CAST(o_orderdate AS DATE)) AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


@query("job_expand", f"""WITH {_SEGMENT_JOBS}
SELECT m || '/' || st AS job_id, CASE WHEN n % 2 = 0 THEN 'order_value' ELSE 'order_count' END AS kpi_name,
  d AS dimension_name, 'weekly_growth,band' AS signals, m AS segment_filter, st || ',X' AS status_filter,
  CASE WHEN st <> 'P' THEN CAST(a AS DATE) END AS period_start, b AS period_end
FROM seg, (VALUES ('priority'), ('region'), ('')) x(d) WHERE m <> 'MACHINERY' AND (d = '') = (st = 'P')""")
def job_expand(t: Tables) -> DataFrame:
    """Job rows per dimension, filters and period parsed, retired signal names replaced."""
    return cf.expand_jobs(segment_jobs(t)).select(
        "job_id", "kpi_name", "dimension_name", F.array_join("signals", ",").alias("signals"),
        F.array_join(F.element_at("filters", "segment"), ",").alias("segment_filter"),
        F.array_join(F.element_at("filters", "status"), ",").alias("status_filter"), "period_start", "period_end")


@query("job_select", f"""WITH {_SEGMENT_JOBS}
SELECT m || '/' || st AS job_id, 'region' AS dimension_name,
  CAST(a AS DATE) AS window_start, b AS window_end
FROM seg WHERE m <> 'MACHINERY' AND st <> 'P' AND n % 2 = 0
UNION ALL SELECT m || '/' || st, '', DATE '1998-04-01', DATE '1998-04-30' FROM seg WHERE m <> 'MACHINERY' AND st = 'P' AND n % 2 = 0""")
def job_select(t: Tables) -> DataFrame:
    """Jobs chosen by KPI and dimension, each with its window: its own if complete, else the default."""
    jobs = cf.expand_jobs(segment_jobs(t))
    chosen = cf.select_jobs(jobs, excluded_kpis=["Order_Count"], dimension="REGION").unionByName(
        cf.select_jobs(jobs, kpi="order_value", dimension=" "))
    return cf.job_windows(chosen, F.lit(APRIL.start), F.lit(APRIL.end)).select(
        "job_id", "dimension_name", "window_start", "window_end")


@query("job_period_push", f"""WITH {_SEGMENT_JOBS}, w AS (SELECT CAST(max(o_orderdate) AS DATE) AS e FROM orders)
SELECT m || '/' || st AS job_id, m AS segment_filter, CAST(CAST(e - 6 AS DATE) AS VARCHAR) || ',' || CAST(e AS VARCHAR) AS period_filter,
  CAST(e - 6 AS DATE) AS period_start, e AS period_end FROM seg, w WHERE m <> 'MACHINERY' AND st <> 'P'""")
def job_period_push(t: Tables) -> DataFrame:
    """The data's last week written into every job's filters, other keys kept."""
    last = t("orders").agg(F.max("o_orderdate").cast("date").alias("last_day")).scalar()
    jobs = cf.expand_jobs(segment_jobs(t)).where("dimension_name = 'region'")
    pushed = cf.push_period(jobs, F.date_sub(last, 6), last)
    return pushed.select(
        "job_id", F.array_join(F.element_at("filters", "segment"), ",").alias("segment_filter"),
        F.array_join(F.element_at("filters", "period"), ",").alias("period_filter"), "period_start", "period_end")


@query("threshold_cascade", """WITH kd AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'order_count' ELSE 'order_value' END AS kpi_name FROM orders),
pairs AS (SELECT kpi_name, d AS dimension_name FROM kd, (VALUES ('priority'), ('segment'), ('region')) x(d)),
lim AS (SELECT round(quantile_disc(o_totalprice, 0.5), 2) AS m FROM orders)
SELECT kpi_name, dimension_name, operator, threshold, severity, priority FROM (
  SELECT kpi_name, dimension_name, 'lt' AS operator, m AS threshold, 'critical' AS severity, 1 AS priority FROM pairs, lim WHERE kpi_name = 'order_value' AND dimension_name = 'priority'
  UNION ALL SELECT kpi_name, dimension_name, 'gt', 7.0, 'info', 2 FROM pairs WHERE kpi_name = 'order_count'
  UNION ALL SELECT kpi_name, dimension_name, 'gt', 10.0, 'info', 3 FROM pairs WHERE kpi_name = 'order_value' AND dimension_name <> 'priority'
  UNION ALL SELECT kpi_name, dimension_name, 'lt', CASE WHEN dimension_name = 'segment' THEN -12.5 ELSE -10.0 END, 'warning', 3 FROM pairs WHERE kpi_name = 'order_value' AND dimension_name <> 'priority'
  UNION ALL SELECT kpi_name, dimension_name, 'between', v, 'info', 3 FROM pairs, (VALUES (-2.0), (5.0)) y(v) WHERE kpi_name = 'order_value' AND dimension_name <> 'priority'
  UNION ALL SELECT kpi_name, dimension_name, 'xx', 0.0, 'info', 3 FROM pairs WHERE kpi_name = 'order_value' AND dimension_name <> 'priority')""")
def threshold_cascade(t: Tables) -> DataFrame:
    """Exact thresholds, else any-dimension ones, else those of the KPI's job signals."""
    kpi = F.when(F.col("o_orderstatus") == "P", "order_count").otherwise("order_value")
    dims = F.explode(F.array(*[F.lit(d) for d in SIGNAL_DIMS]))
    pairs = t("orders").select(kpi.alias("kpi_name")).distinct().withColumn("dimension_name", dims)
    median = t("orders").agg(F.round(F.expr("percentile_disc(0.5) within group (order by o_totalprice)"), 2).alias("threshold"))
    exact = median.select(F.lit("order_value").alias("kpi_name"), F.lit("priority").alias("dimension_name"),
                          F.lit("lt").alias("operator"), "threshold", F.lit("critical").alias("severity"))
    general = cf.inline_rows(t.spark, [("order_count", None, "gt", 7.0, "info")], cf.THRESHOLD_SCHEMA)
    return cf.threshold_cascade(
        pairs, exact.unionByName(general), cf.jobs_frame(t.spark, JOBS), cf.signal_defs_frame(t.spark, DEFINITIONS))


# --- signals ----------------------------------------------------------------------------------

_DETECT = f"""WITH {q.OS}, g AS ({q.by_each('os', q.pick(q.ORDER_COLUMNS, 'priority', 'segment'), f"{q.order_kpi('order_value', q.od(q.APRIL))} AS c, {q.order_kpi('order_value', q.od(q.MARCH_30))} AS p")}),
{_DEFS} SELECT dimension, dimension_value, signal_name, severity, c AS kpi_value, p AS prior_value, v AS feature_value FROM (
  SELECT *, round({q.pct_abs('c', 'p')}, 2) AS v FROM g) JOIN defs ON feature_name = 'mom_growth_pct' WHERE c IS NOT NULL AND {fires('v')}"""


@query("signal_detect", _DETECT)
def signal_detect(t: Tables) -> DataFrame:
    """Monthly growth of order value by priority and segment against every definition of that feature."""
    values = snapshot(ORDERS, t, ["order_value"], ["priority", "segment"], APRIL, ["mom_growth_pct"])
    hits = sg.detect(values, cf.signal_defs_frame(t.spark, DEFINITIONS))
    return hits.select("dimension", "dimension_value", "signal_name", "severity", "kpi_value", "prior_value", "feature_value")


@query("signal_rows", f"WITH {SIGNALS} SELECT {_S} FROM sig")
def signal_rows(t: Tables) -> DataFrame:
    """Signal records of three jobs with stable ids."""
    return base_signals(t).select(*SIGNAL_COLUMNS)


def _all_jobs_sql() -> str:
    o, l = q.ORDER_COLUMNS, q.LINE_COLUMNS
    mom = (q.od(q.APRIL), q.od(q.MARCH_30))
    lmom = (q.ld(q.APRIL), q.ld(q.MARCH_30))
    anl = "l_returnflag IN ('A', 'N')"
    parts = []

    def snap(job, kpi, base, cols, now, before, change, signals):
        inner = q.by_each(base, cols, f"{now} AS c, {before} AS p", self_total="self" in signals)
        parts.append(f"SELECT {job} AS job_id, '{kpi}' AS kpi_name, dimension, dimension_value, s AS signal_name, round({change}, 2) AS v, c FROM ({inner}), (VALUES {', '.join(f"('{x}')" for x in signals['names'])}) y(s)")

    three = {"names": ["monthly_growth", "monthly_degrowth", "band", "no_upper", "odd_op"]}
    snap(1, "order_value", "os", q.pick(o, "priority", "segment", "nation"), q.order_kpi("order_value", mom[0]),
         q.order_kpi("order_value", mom[1]), q.pct_abs("c", "p"), three)
    points = f"{q.scale100('c')} - {q.scale100('p')}"
    snap(2, "return_rate", "ls", q.pick(l, "brand"), q.line_kpi("return_rate", lmom[0]), q.line_kpi("return_rate", lmom[1]),
         points, {"names": ["monthly_growth", "monthly_degrowth"]})
    snap(6, "finished_rate", "os", q.pick(o, "nation"), q.order_kpi("finished_rate", mom[0]), q.order_kpi("finished_rate", mom[1]),
         points, {"names": ["monthly_growth"]})
    snap(6, "finished_rate", "os", q.pick(o, "nation"), q.order_kpi("finished_rate", mom[0]),
         q.order_kpi("finished_rate", q.od(("1998-03-25", "1998-04-01"))), points, {"names": ["weekly_growth"]})
    snap(3, "order_count", "os", q.pick(o, "region"), q.order_kpi("order_count", mom[0]), q.order_kpi("order_count", q.od(q.APRIL_97)),
         q.pct_abs("c", "p"), {"names": ["yearly_growth"], "self": 1})
    snap(5, "revenue", f"(SELECT * FROM ls WHERE {anl})", q.pick(l, "brand", "part_type"), q.line_kpi("revenue", lmom[0]),
         q.line_kpi("revenue", lmom[1]), q.pct_abs("c", "p"), {"names": ["monthly_growth"]})
    accel = q.by_each("os", q.pick(o, "region"), f"{q.order_kpi('order_count', mom[0])} AS c, {q.order_kpi('order_count', mom[1])} AS p, "
                      f"{q.order_kpi('order_count', q.od(q.FEBRUARY_28))} AS b", self_total=True)
    parts.append(f"SELECT 3, 'order_count', dimension, dimension_value, 'slowing', round({q.pct_abs('c', 'p')} - {q.pct_abs('p', 'b')}, 2), c FROM ({accel})")
    rank = q.by_each("os", q.pick(o, "region"), f"{q.order_kpi('order_count')} AS c", q.od(q.APRIL))
    parts.append(f"SELECT 3, 'order_count', dimension, dimension_value, 'laggard', round(CASE WHEN count(*) OVER () >= 2 THEN rank() OVER (ORDER BY c DESC)::DOUBLE / count(*) OVER () * 100 END, 2), c FROM ({rank})")
    z = q.by_each("ls", q.pick(l, "brand"), f"{q.line_kpi('return_rate')} AS c", q.ld(q.APRIL))
    parts.append(f"SELECT 2, 'return_rate', dimension, dimension_value, 'outlier', round((c - avg(c) OVER ()) / nullif(stddev_samp(c) OVER (), 0), 2), c FROM ({z})")
    months = "\nUNION ALL\n".join(
        f"SELECT '{d}' AS dimension, {c} AS dimension_value, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, {q.line_kpi('revenue')} AS c "
        f"FROM ls WHERE {anl} AND {q.ld(('1997-09-01', '1998-05-01'))} GROUP BY 2, 3" for d, c in q.pick(l, "brand", "part_type").items())
    parts.append(f"""SELECT 5, 'revenue', dimension, dimension_value, 'volatile', v, c FROM (
      SELECT *, round(stddev_samp(c) OVER (PARTITION BY dimension, dimension_value ORDER BY m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 2) AS v FROM ({months})) WHERE m >= DATE '1998-04-01'""")
    extra = """defs2(signal_name, operator, threshold, threshold2) AS (SELECT signal_name, operator, threshold, threshold2 FROM defs UNION ALL VALUES
  ('laggard', 'gte', 90.0, NULL), ('outlier', 'gt', 1.0, NULL), ('slowing', 'lt', -15.0, NULL), ('volatile', 'gt', 0.0, NULL))"""
    return (f"WITH {q.OS}, {q.LS}, {_DEFS}, {extra}, vals AS ({' UNION ALL '.join(parts)}) "
            "SELECT job_id, kpi_name, dimension, dimension_value, vals.signal_name, v AS feature_value, round(c, 2) AS current_kpi_value, "
            f"round(v - threshold, 2) AS breach_delta FROM vals JOIN defs2 ON vals.signal_name = defs2.signal_name WHERE c IS NOT NULL AND v IS NOT NULL AND {fires('v')}")


@query("signal_all_jobs", _all_jobs_sql())
def signal_all_jobs(t: Tables) -> DataFrame:
    """Every active job of two stars: snapshot, acceleration, rank, z-score and series signals."""
    return _shown(sg.detect_jobs(t.spark, STARS, t, JOBS, DEFINITIONS, APRIL, F.lit(RUN_AT), top_n=False))


@query("signal_discount_depth", f"""WITH {q.LS}, g AS ({q.by_each('ls', q.pick(q.LINE_COLUMNS, 'brand', 'return_flag'), f"{q.line_kpi('revenue')} AS c, {q.line_kpi('avg_discount')} AS v", q.ld(q.APRIL))})
SELECT 20 AS job_id, 'revenue' AS kpi_name, dimension, dimension_value, 'deep_discount' AS signal_name, round(v, 2) AS feature_value, round(c, 2) AS current_kpi_value,
  round(v - 0.05, 2) AS breach_delta FROM g WHERE v > 0.05""")
def signal_discount_depth(t: Tables) -> DataFrame:
    """A job on a feature that is read from another KPI of the star."""
    deep = cf.SignalDef("deep_discount", "discount_depth", "gt", 0.05, None, "info")
    jobs = [cf.Job(20, "revenue", ("brand", "return_flag"), ("deep_discount",))]
    return _shown(sg.detect_jobs(t.spark, STARS, t, jobs, [deep], APRIL, F.lit(RUN_AT)))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("job_id", "kpi_name", "dimension", "dimension_value", "signal_name", "feature_value",
                        "current_kpi_value", "breach_delta")


@query("signal_run_top_n", f"""SELECT * EXCLUDE (rn) FROM (SELECT a.*, row_number() OVER (PARTITION BY job_id, kpi_name, dimension, signal_name
  ORDER BY CASE WHEN signal_name = 'monthly_degrowth' THEN feature_value ELSE -feature_value END, dimension_value) AS rn FROM ({_all_jobs_sql()}) a)
WHERE NOT (signal_name = 'monthly_growth' AND rn > 3) AND NOT (signal_name = 'monthly_degrowth' AND rn > 2)""")
def signal_run_top_n(t: Tables) -> DataFrame:
    """The same jobs with the row limits of their definitions, as a run applies them."""
    return _shown(sg.detect_jobs(t.spark, STARS, t, JOBS, DEFINITIONS, APRIL, F.lit(RUN_AT)))


_TOP = f"""WITH {SIGNALS}, p AS (SELECT *, row_number() OVER (PARTITION BY kpi_name, dimension, signal_name
  ORDER BY CASE WHEN operator IN ('lt', 'lte') THEN feature_value ELSE -feature_value END, dimension_value) AS rn FROM sig)
SELECT {_S} FROM p WHERE top_n IS NULL OR rn <= top_n"""


@query("signal_top_n", _TOP)
def signal_top_n(t: Tables) -> DataFrame:
    """The worst rows of signals that have a cap; the others in full."""
    limits = cf.signal_defs_frame(t.spark, DEFINITIONS).select("signal_name", "top_n")
    most = max(d.top_n or 0 for d in DEFINITIONS)
    return sg.worst_first(base_signals(t).join(limits, "signal_name", "left"), most).select(*SIGNAL_COLUMNS)


@query("signal_consistency", f"""WITH {SIGNALS} SELECT signal_id, kpi_name, dimension, dimension_value, feature_value,
  round({q.pct_abs('current_kpi_value', 'prev_kpi_value')}, 2) AS expected,
  abs(feature_value - {q.pct_abs('current_kpi_value', 'prev_kpi_value')}) < 0.01 AS matches FROM sig WHERE prev_kpi_value IS NOT NULL""")
def signal_consistency(t: Tables) -> DataFrame:
    return sg.change_check(base_signals(t))


# --- signal history: monthly growth signals over all years -------------------------------------

HISTORY = f"""{q.OS}, lng AS (SELECT 'segment' AS dimension, c_mktsegment AS dimension_value, o_orderdate, o_totalprice FROM os
  UNION ALL SELECT 'priority', o_orderpriority, o_orderdate, o_totalprice FROM os UNION ALL SELECT 'nation', n_name, o_orderdate, o_totalprice FROM os),
ser AS (SELECT dimension, dimension_value, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, {q.total('o_totalprice')} AS v FROM lng GROUP BY 1, 2, 3),
gro AS (SELECT *, lag(v) OVER (PARTITION BY dimension, dimension_value ORDER BY m) AS p FROM ser),
chg AS (SELECT *, round({q.pct('v', 'p')}, 2) AS f FROM gro), {_DEFS},
hist AS (SELECT sha256(concat_ws('|', '9', 'order_value', dimension, dimension_value, signal_name, 'mom_growth_pct', CAST(m AS VARCHAR), CAST(last_day(m) AS VARCHAR))) AS signal_id,
  'order_value' AS kpi_name, dimension, dimension_value, signal_name, severity, f AS feature_value, round(v, 2) AS current_kpi_value,
  round(p, 2) AS prev_kpi_value, CAST(last_day(m) AS TIMESTAMP) AS detected_at FROM chg JOIN defs ON feature_name = 'mom_growth_pct' WHERE {fires('f')})"""

HISTORY_COLUMNS = ("signal_id", "kpi_name", "dimension", "dimension_value", "signal_name", "severity", "feature_value",
                   "current_kpi_value", "prev_kpi_value")
_H = ", ".join(HISTORY_COLUMNS)


def signal_history(t: Tables) -> DataFrame:
    """One detection run per month: growth of order value by segment, priority and nation."""
    monthly = ft.kpi_series(ORDERS, t, ["order_value"], ["segment", "priority", "nation"])
    grown = ft.add_series_features(monthly, {"feature_value": (ft.growth_pct, {})})
    series = ft.Series()
    values = grown.withColumns({
        "prior_value": series.lag(F.col("kpi_value")), "job_id": F.lit(9), "feature_name": F.lit("mom_growth_pct"),
    })
    hits = sg.detect(values, cf.signal_defs_frame(t.spark, DEFINITIONS))
    end = F.last_day("period_start")
    return sg.signal_rows(hits, F.col("period_start"), end, end.cast("timestamp"))


@query("entity_signal_counts", f"""WITH {HISTORY} SELECT dimension_value, count(*) AS signal_count FROM hist
WHERE dimension = 'nation' AND trim(dimension_value) <> '' GROUP BY 1 HAVING count(*) >= 20""")
def entity_signal_counts(t: Tables) -> DataFrame:
    return sg.entity_counts(signal_history(t), "nation", 20)


@query("signal_counts", f"WITH {HISTORY} SELECT severity, dimension, count(*) AS signal_count FROM hist GROUP BY 1, 2")
def signal_counts(t: Tables) -> DataFrame:
    return sg.counts_by(signal_history(t), "severity", "dimension")


@query("entity_signals", f"""WITH {HISTORY} SELECT {_H} FROM hist WHERE dimension = 'segment' AND dimension_value = 'BUILDING'
ORDER BY detected_at DESC, signal_id LIMIT 50""")
def entity_signals(t: Tables) -> DataFrame:
    """The newest signals of one member, a top-k read."""
    return sg.entity_signals(signal_history(t), "segment", " building ", ["order_value"], 50).select(*HISTORY_COLUMNS)


# --- WHY --------------------------------------------------------------------------------------


@query("why_route_a", f"WITH {WHYS} SELECT {_W} FROM why WHERE dep_kpi_name IS NULL AND signal_name <> 'weekly_growth'")
def why_route_a(t: Tables) -> DataFrame:
    """Monthly and yearly signals by every other dimension."""
    return _monthly(t).where("dep_kpi_name is null")


@query("why_route_b", f"WITH {WHYS} SELECT {_W} FROM why WHERE dep_kpi_name IS NOT NULL AND signal_name <> 'weekly_growth'")
def why_route_b(t: Tables) -> DataFrame:
    """Monthly and yearly signals by dependent KPI."""
    return _monthly(t).where("dep_kpi_name is not null")


def _monthly(t: Tables) -> DataFrame:
    return wy.explain(base_signals(t), ORDERS, t, SIGNAL_KPIS, SIGNAL_DIMS, APRIL, ["mom_growth_pct", "yoy_growth_pct"],
                      F.lit(RUN_AT)).select(*WHY_SHOWN)


@query("why_all", f"WITH {WHYS} SELECT {_W} FROM why")
def why_all(t: Tables) -> DataFrame:
    """Both routes over both windows."""
    return base_whys(t).select(*WHY_SHOWN)


@query("why_rationale", f"WITH {WHYS} SELECT why_id, rationale FROM why")
def why_rationale(t: Tables) -> DataFrame:
    return base_whys(t).select("why_id", "rationale")


def _union_sql() -> str:
    parts = []
    for other in ("part_type", "return_flag", "line_status"):
        parts.append(f"SELECT '{other}' AS tag, p_brand AS signal_dim_value, {q.LINE_COLUMNS[other]} AS dimension_value, "
                     f"{q.line_kpi('revenue')} AS kpi_value FROM ls WHERE {q.ld(q.APRIL)} GROUP BY 2, 3")
    for dep in ("quantity", "avg_discount"):
        parts.append(f"SELECT '{dep}', p_brand, p_brand, {q.line_kpi(dep)} FROM ls WHERE {q.ld(q.APRIL)} GROUP BY p_brand")
    return f"WITH {q.LS}\n" + "\nUNION ALL\n".join(parts)


@query("why_union", _union_sql())
def why_union(t: Tables) -> DataFrame:
    """All legs of revenue by brand: three other dimensions and two dependencies, from one scan."""
    return wy.consolidated(LINES, t, "revenue", "brand", APRIL)


@query("why_top_contributors", f"""WITH {q.OS}, g AS ({q.by_each('os', q.pick(q.ORDER_COLUMNS, 'priority', 'status', 'nation', 'region'), q.order_kpi('order_value') + ' AS kpi_value', q.od(('1998-04-01', '1998-05-01')) + " AND c_mktsegment = 'BUILDING'")}),
m AS (SELECT *, CAST(sum(CAST(kpi_value AS DECIMAL(28,8))) OVER (PARTITION BY dimension) AS DOUBLE) / count(*) OVER (PARTITION BY dimension) AS mean_value FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY kpi_value, dimension_value) AS place FROM m WHERE kpi_value < mean_value)
SELECT 'order_value' AS kpi_name, dimension, dimension_value, kpi_value, round(mean_value, 2) AS mean_value, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def why_top_contributors(t: Tables) -> DataFrame:
    """For one pinned segment, the three lowest members below the mean of each other dimension."""
    found = wy.drill_down(ORDERS, t, "order_value", "segment", "BUILDING", APRIL)
    return found.withColumn("mean_value", F.round("mean_value", 2))


@query("why_dependency_values", f"""WITH {q.LS} SELECT 'quantity' AS kpi_name, 'brand' AS dimension, p_brand AS dimension_value, {q.line_kpi('quantity')} AS kpi_value
FROM ls WHERE {q.ld(q.APRIL)} AND p_brand = 'Brand#17' GROUP BY 3
UNION ALL SELECT 'avg_discount', 'brand', p_brand, {q.line_kpi('avg_discount')} FROM ls WHERE {q.ld(q.APRIL)} AND p_brand = 'Brand#17' GROUP BY 3""")
def why_dependency_values(t: Tables) -> DataFrame:
    return wy.dependency_values(LINES, t, "revenue", "brand", "Brand#17", APRIL)


@query("why_windows", f"""WITH {HISTORY}, w AS (SELECT *, CAST(date_trunc('month', detected_at) AS DATE) AS m FROM hist)
SELECT signal_id, CASE WHEN dimension = 'nation' THEN DATE '1998-04-06' WHEN severity = 'info' THEN m ELSE DATE '2001-12-31' END AS window_start,
  CASE WHEN dimension = 'nation' THEN DATE '1998-04-12' WHEN severity = 'info' THEN last_day(m) ELSE DATE '2001-12-31' END AS window_end FROM w""")
def why_windows(t: Tables) -> DataFrame:
    """Window of each explanation: the job's period, else the stored text's, else the as-of day."""
    signals = signal_history(t).withColumns({
        "job_id": F.when(F.col("dimension") == "nation", 7).otherwise(9),
        "kpi_query": F.when(F.col("severity") == "info", F.col("kpi_query")),
    })
    return wy.explained_windows(signals, cf.jobs_frame(t.spark, BASE_JOBS), F.lit(date(2001, 12, 31))).select(
        "signal_id", "window_start", "window_end")


AS_OF = date(1998, 4, 15)


def mixed_history(t: Tables) -> DataFrame:
    """The history with windows of all kinds: nations over their job's week, growth over its month, the rest over one day.

    Upper bounds are not stored, and one signal of the priorities is of a feature that no drill explains.
    """
    nation, band = F.col("dimension") == "nation", F.col("signal_name") == "band"
    return signal_history(t).withColumns({
        "job_id": F.when(nation, 7).otherwise(9),
        "kpi_query": F.when(F.col("severity") == "info", F.col("kpi_query")),
        "feature_name": F.when(nation, "wow_growth_pct").when(band & (F.col("dimension") == "priority"), "z_score").otherwise(F.col("feature_name")),
    }).drop("threshold2")


def _sweep_sql() -> str:
    """Every window beside the one before it, and one grouped query per signal dimension, drilled dimension and KPI."""
    drill = []
    for own in ("segment", "priority", "nation"):
        a = q.ORDER_COLUMNS[own]
        for kpi in ("order_value", "order_count", "avg_order_value"):
            head = (f"SELECT ws, we, feature_name, '{kpi}' AS kpi_name, '{own}' AS dimension, {a} AS dimension_value, "
                    f"{q.order_kpi(kpi, 'is_now')} AS c, {q.order_kpi(kpi, 'is_before')} AS p")
            drill.append(f"{head}, NULL AS drill_dimension, NULL AS drill_value FROM seen GROUP BY ALL")
            for other, b in q.ORDER_COLUMNS.items():
                if other != own and kpi == "order_value":
                    drill.append(f"{head}, '{other}' AS drill_dimension, {b} AS drill_value FROM seen GROUP BY ALL")
    test = fires("d.change_pct", "s.threshold", "s.threshold2").replace("operator", "s.operator")
    same = "s.dimension = d.dimension AND s.dimension_value = d.dimension_value AND s.feature_name = d.feature_name AND s.ws = d.ws AND s.we = d.we"
    return f"""{HISTORY}, sigs AS (
  SELECT h.signal_id, h.kpi_name, h.dimension, h.dimension_value, h.signal_name, operator, threshold, threshold2,
    CASE WHEN dimension = 'nation' THEN 'wow_growth_pct' WHEN dimension = 'priority' AND h.signal_name = 'band' THEN 'z_score' ELSE 'mom_growth_pct' END AS feature_name,
    CASE WHEN dimension = 'nation' THEN DATE '1998-04-06' WHEN h.severity = 'info' THEN CAST(date_trunc('month', detected_at) AS DATE) ELSE DATE '1998-04-15' END AS ws,
    CASE WHEN dimension = 'nation' THEN DATE '1998-04-12' WHEN h.severity = 'info' THEN last_day(detected_at) ELSE DATE '1998-04-15' END AS we
  FROM hist h JOIN defs USING (signal_name)
), asked AS (SELECT DISTINCT ws, we, feature_name,
    CASE WHEN feature_name = 'wow_growth_pct' THEN CAST(ws - 7 AS DATE) ELSE CAST(ws - INTERVAL 1 MONTH AS DATE) END AS ps,
    CASE WHEN feature_name = 'wow_growth_pct' THEN CAST(ws - 1 AS DATE) ELSE CAST(we - INTERVAL 1 MONTH AS DATE) END AS pe
  FROM sigs WHERE feature_name <> 'z_score'
), seen AS MATERIALIZED (
  SELECT asked.*, os.*, o_orderdate >= ws AND o_orderdate < we + 1 AS is_now, o_orderdate >= ps AND o_orderdate < pe + 1 AS is_before
  FROM asked JOIN os ON (o_orderdate >= ws AND o_orderdate < we + 1) OR (o_orderdate >= ps AND o_orderdate < pe + 1)
), drill AS (SELECT *, round({q.pct_abs('c', 'p')}, 2) AS change_pct FROM ({' UNION ALL '.join(drill)})
), deps(parent_kpi, dependent_kpi) AS (VALUES ('order_value', 'order_count'), ('order_value', 'avg_order_value')
), legs AS (
  SELECT s.*, d.drill_dimension AS dimension_name, d.drill_value AS member, CAST(NULL AS VARCHAR) AS dep_kpi_name,
    CAST(NULL AS VARCHAR) AS dep_kpi_label, 'Cross-dimension ' || d.drill_dimension AS subject, c, p, change_pct
  FROM sigs s JOIN drill d ON {same} AND s.kpi_name = d.kpi_name
  WHERE d.drill_dimension IS NOT NULL AND c IS NOT NULL AND change_pct IS NOT NULL AND {test}
  UNION ALL
  SELECT s.*, s.dimension, s.dimension_value, e.dependent_kpi, s.kpi_name || ' by ' || s.dimension, 'Dependent KPI ' || e.dependent_kpi, c, p, change_pct
  FROM sigs s JOIN deps e ON s.kpi_name = e.parent_kpi JOIN drill d ON {same} AND d.kpi_name = e.dependent_kpi
  WHERE d.drill_dimension IS NULL AND c IS NOT NULL AND change_pct IS NOT NULL AND {test}
), swept AS (SELECT sha256(concat_ws('|', signal_id, coalesce(dep_kpi_name, ''), dimension_name, member)) AS why_id, signal_id, kpi_name,
    dimension_name, member AS dimension_value, signal_name, dep_kpi_name, dep_kpi_label,
    subject || ' ' || member || CASE WHEN change_pct > 0 THEN ' increased by ' ELSE ' decreased by ' END
      || CAST(round(CAST(abs(change_pct) AS DECIMAL(18,2)), 1) AS VARCHAR) || '%' AS rationale,
    round(c, 2) AS current_value, round(p, 2) AS prev_value, change_pct, CAST(ws AS VARCHAR) || ' to ' || CAST(we AS VARCHAR) AS period,
    ws AS period_start, we AS period_end FROM legs)"""


def _swept(t: Tables) -> str:
    """Sweep the mixed history twice, in two files, and give the folder; the second sweep finds nothing new."""
    root = f"{stage_root(t.spark).rstrip('/')}/sweep-{uuid4().hex}"
    signals = settled(mixed_history(t))
    signals.repartition(2, "signal_id").write.parquet(f"{root}/signals")

    def explain_batch(batch: DataFrame) -> DataFrame:
        return wy.explain_signals(batch, STARS, t, BASE_JOBS, DEFINITIONS, F.lit(AS_OF), F.lit(RUN_AT))

    for _ in range(2):
        explain_new_signals(t.spark, f"{root}/signals", f"{root}/swept", explain_batch, signals.schema,
                            report=lambda fresh, whys: wy.unexplained(fresh, whys, STARS))
    return f"{root}/swept"


@query("why_sweep", f"WITH {_sweep_sql()} SELECT {_W} FROM swept")
def why_sweep(t: Tables) -> DataFrame:
    """Each signal of the mixed history explained over its own window, by micro-batches with a ledger."""
    return t.spark.read.parquet(f"{_swept(t)}/whys").select(*WHY_SHOWN)


@query("why_unsupported", f"""WITH {_sweep_sql()} SELECT signal_id, kpi_name, feature_name,
  CASE WHEN feature_name = 'z_score' THEN 'the feature cannot be drilled' ELSE 'no other member or KPI passes the threshold' END AS reason
FROM sigs WHERE signal_id NOT IN (SELECT signal_id FROM swept)""")
def why_unsupported(t: Tables) -> DataFrame:
    """The signals of the sweep that have no explanation, with the reason."""
    return t.spark.read.parquet(f"{_swept(t)}/unexplained").select("signal_id", "kpi_name", "feature_name", "reason")


@query("why_ledger", f"WITH {_sweep_sql()} SELECT signal_id, signal_id IN (SELECT signal_id FROM swept) AS explained FROM sigs")
def why_ledger(t: Tables) -> DataFrame:
    """Every signal stands in the ledger once, as explained or as reported."""
    root = _swept(t)
    whys = t.spark.read.parquet(f"{root}/whys").select("signal_id").distinct().withColumn("explained", F.lit(True))
    return ledger_rows(t.spark, f"{root}/ledger").select("signal_id").join(whys, "signal_id", "left").select(
        "signal_id", F.coalesce("explained", F.lit(False)).alias("explained"))


def ledger(signals: DataFrame) -> DataFrame:
    """Ids that count as processed: about half, chosen by the id itself."""
    return signals.where(F.substring("signal_id", 1, 1) < "8").select("signal_id")


@query("why_pending", f"WITH {HISTORY} SELECT {_H} FROM hist WHERE substr(signal_id, 1, 1) >= '8'")
def why_pending(t: Tables) -> DataFrame:
    """Signals not yet in the ledger of processed ids."""
    signals = signal_history(t)
    return wy.pending(signals, ledger(signals)).select(*HISTORY_COLUMNS)


@query("why_rerun", f"""WITH {WHYS} SELECT {_W} FROM why""")
def why_rerun(t: Tables) -> DataFrame:
    """Some signals explained again in the stored table: their rows go, are computed anew, and nothing else changes."""
    signals = stored_signals(t)
    table = KeyedTable(t.spark, f"{stage_root(t.spark).rstrip('/')}/whys-{uuid4().hex}", ["signal_id"], 16)
    table.create(base_whys(t, signals))
    again = ledger(signals)
    table.replace(again, base_whys(t, signals.join(again, "signal_id", "left_semi")))
    return table.read().select(*WHY_SHOWN)


@query("why_missing_ids", f"WITH {HISTORY} SELECT DISTINCT 'x' || signal_id AS signal_id FROM hist WHERE substr(signal_id, 1, 1) < '8'")
def why_missing_ids(t: Tables) -> DataFrame:
    """Requested ids that no signal has."""
    signals = signal_history(t)
    asked = ledger(signals).unionByName(ledger(signals).select(F.concat(F.lit("x"), "signal_id").alias("signal_id")))
    return wy.missing_ids(asked, signals)


@query("run_summary", f"""WITH {WHYS}, cl AS (SELECT DISTINCT s.dimension, s.dimension_value, w.period_start, w.period_end FROM why w JOIN sig s USING (signal_id) WHERE s.dimension IN ('priority', 'segment'))
SELECT 'signals' AS stage, (SELECT count(*) FROM sig) AS "rows" UNION ALL SELECT 'whys', (SELECT count(*) FROM why)
UNION ALL SELECT 'standard', (SELECT count(*) FROM (SELECT DISTINCT kpi_name, dimension FROM sig))
UNION ALL SELECT 'dimensional', (SELECT count(*) FROM cl)
UNION ALL SELECT 'rollup', (SELECT count(*) FROM (SELECT DISTINCT s.kpi_name, w.period_start FROM sig s LEFT JOIN why w ON w.kpi_name = s.kpi_name))""")
def run_summary(t: Tables) -> DataFrame:
    """The whole run, with the rows each stage wrote."""
    return run.run(t.spark, [ORDERS], t, BASE_JOBS, DEFINITIONS, APRIL, F.lit(RUN_AT), ["priority", "segment"]).counts()
