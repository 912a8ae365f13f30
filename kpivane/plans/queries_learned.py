"""Priors and anomalies fitted to the history of KPIs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cube import cube_sets, day_cube
from ..operators.learned import fit_anomalies, fit_priors, replace_version
from ..sources import store as st
from ..sources.tables import Tables
from . import sql as q
from .registry import query
from .retail import ORDERS

KPIS = ("order_value", "order_count", "avg_order_value", "customers")
DIMS = ("segment", "SELF")
VERSION, FITTED_AT = "v2", datetime(2001, 8, 6)
PRIOR_COLUMNS = ("prior_id", "target_kpi", "regressor", "coef", "p_value", "lag", "n", "business_interpretation", "model_version", "is_active")
ANOMALY_COLUMNS = ("anomaly_id", "kpi_name", "week_start_date", "kpi_value", "anomaly_score", "anomaly_flag", "top_driver", "dimension_name",
                   "dimension_value", "model_version", "is_active")


def _priors_sql() -> str:
    values = ", ".join(f"{q.order_kpi(k)} AS {k}" for k in KPIS)
    week = "CAST(date_trunc('week', o_orderdate) AS DATE)"
    rows = "\nUNION ALL\n".join(
        f"SELECT '{y}' AS target_kpi, '{x}' AS regressor, g.lag, a.{y} AS y, b.{x} AS x FROM lv a, (VALUES (0), (1), (2), (3), (4)) g(lag), lv b "
        f"WHERE a.d = b.d AND a.m = b.m AND a.w = b.w + 7 * g.lag" for y in KPIS for x in KPIS if x != y)
    even = "sin(th) * list_sum(list_transform(generate_series(0, CAST((v - 2) / 2 - 0.25 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos(th), 2 * k)))"
    odd = "2 / pi() * (th + CASE WHEN v > 1 THEN sin(th) * list_sum(list_transform(generate_series(0, CAST((v - 3) / 2 - 0.25 AS BIGINT)), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * k + 1))) ELSE 0 END)"
    return f"""{q.OS}, lv AS MATERIALIZED (
  SELECT 'SELF' AS d, 'ALL' AS m, {week} AS w, {values} FROM os GROUP BY 3 UNION ALL SELECT 'segment', c_mktsegment, {week}, {values} FROM os GROUP BY 2, 3
), fits AS (SELECT target_kpi, regressor, lag, count(*) AS n, regr_slope(y, x) AS coef, corr(y, x) AS r FROM ({rows}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3
), angles AS (SELECT *, n - 2 AS v, atan(abs(r) / sqrt(greatest(1 - r * r, 1e-300))) AS th FROM fits WHERE n > 2 AND coef IS NOT NULL AND NOT isnan(r)
), tested AS (SELECT *, round(greatest(0.0, 1 - CASE WHEN v % 2 = 0 THEN {even} ELSE {odd} END), 6) AS p_value FROM angles
), ranked AS (SELECT *, row_number() OVER (PARTITION BY target_kpi, regressor ORDER BY p_value, lag) AS rn FROM tested
), priors AS (SELECT sha256(concat_ws('|', target_kpi, regressor, '{VERSION}')) AS prior_id, target_kpi, regressor,
  CASE WHEN abs(coef) >= 1 THEN round(coef, 3) ELSE round(coef, 9) END AS coef, p_value, lag, n,
  target_kpi || CASE WHEN coef > 0 THEN ' rises with ' ELSE ' falls with ' END || regressor || ' '
    || CASE lag WHEN 0 THEN 'in the same week' WHEN 1 THEN 'a week later' ELSE lag || ' weeks later' END AS business_interpretation,
  '{VERSION}' AS model_version, p_value <= 0.1 AS is_active FROM ranked WHERE rn = 1)"""


def _cube(t: Tables) -> DataFrame:
    return day_cube(ORDERS, t, KPIS, cube_sets(DIMS))


def _priors(t: Tables) -> DataFrame:
    return fit_priors(_cube(t), ORDERS, KPIS, DIMS, VERSION, F.lit(FITTED_AT))


@query("priors_fit", f"WITH {_priors_sql()} SELECT {', '.join(PRIOR_COLUMNS)} FROM priors")
def priors_fit(t: Tables) -> DataFrame:
    """Four KPIs against each other with lags up to four weeks, in total and within segments."""
    return _priors(t).select(*PRIOR_COLUMNS)


@query("priors_in_use", f"WITH {_priors_sql()} SELECT {', '.join(PRIOR_COLUMNS)} FROM priors WHERE target_kpi = 'order_value' AND is_active AND p_value <= 0.05")
def priors_in_use(t: Tables) -> DataFrame:
    """A new fit retires the rows of an earlier version; the lookup reads what is active."""
    fresh = _priors(t)
    older = fresh.withColumns({"model_version": F.lit("v1"), "prior_id": F.concat(F.lit("old-"), "prior_id")})
    stored = replace_version(older, fresh, ["target_kpi", "regressor", "model_version"])
    return st.correlation_priors(stored, ["Order_Value"], 0.05).select(*PRIOR_COLUMNS)


def _anomalies_sql() -> str:
    week = "CAST(date_trunc('week', o_orderdate) AS DATE)"
    series, cells = [], []
    for kpi in ("order_value", "order_count"):
        for d, c in (("segment", "c_mktsegment"), ("priority", "o_orderpriority"), ("SELF", "'ALL'")):
            series.append(f"SELECT '{kpi}' AS kpi_name, '{d}' AS dimension, {c} AS member, {week} AS w, {q.order_kpi(kpi)} AS v FROM os GROUP BY 3, 4")
            cells.append(f"SELECT '{kpi}' AS kpi_name, '{d}' AS dimension, {c} AS member, r_name AS part, {week} AS w, {q.order_kpi(kpi)} AS v FROM os GROUP BY 3, 4, 5")
    span = "RANGE BETWEEN INTERVAL 182 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING"
    return f"""{q.OS}, ser AS ({' UNION ALL '.join(series)}), cell AS ({' UNION ALL '.join(cells)}),
held AS (SELECT *, list(v) OVER (PARTITION BY kpi_name, dimension, member ORDER BY w {span}) AS l FROM ser),
base AS (SELECT *, list_aggregate(l, 'median') AS b FROM held WHERE len(l) >= 8),
rated AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - b)), 'median') * 1.4826 AS s FROM base),
moved AS (SELECT *, round(abs(v - coalesce(list_aggregate(l, 'median'), 0)), 4) AS move FROM (
  SELECT *, list(v) OVER (PARTITION BY kpi_name, dimension, member, part ORDER BY w {span}) AS l FROM cell)),
drivers AS (SELECT *, row_number() OVER (PARTITION BY kpi_name, dimension, member, w ORDER BY move DESC, part) AS rn FROM moved),
timeline AS (SELECT sha256(concat_ws('|', r.kpi_name, CAST(r.w AS VARCHAR), r.dimension, r.member, '{VERSION}')) AS anomaly_id, r.kpi_name, r.w AS week_start_date,
  round(r.v, 4) AS kpi_value, round((r.v - b) / nullif(s, 0), 4) AS anomaly_score,
  CASE WHEN coalesce(abs(round((r.v - b) / nullif(s, 0), 4)) > 3.5, r.v <> b) THEN -1 ELSE 1 END AS anomaly_flag, 'region=' || part AS top_driver,
  r.dimension AS dimension_name, r.member AS dimension_value, '{VERSION}' AS model_version, true AS is_active
FROM rated r LEFT JOIN drivers d ON d.rn = 1 AND r.kpi_name = d.kpi_name AND r.dimension = d.dimension AND r.member = d.member AND r.w = d.w)"""


def _anomalies(t: Tables) -> DataFrame:
    return fit_anomalies(ORDERS, t, ["order_value", "order_count"], ["segment", "priority", "SELF"], "region", VERSION, F.lit(FITTED_AT))


@query("anomaly_fit", f"WITH {_anomalies_sql()} SELECT {', '.join(ANOMALY_COLUMNS)} FROM timeline")
def anomaly_fit(t: Tables) -> DataFrame:
    """Two KPIs by segment, priority and in total: every week against the half year before, and the region that moved most."""
    return _anomalies(t).select(*ANOMALY_COLUMNS)


@query("anomaly_recent", f"WITH {_anomalies_sql()} SELECT {', '.join(ANOMALY_COLUMNS)} FROM timeline WHERE kpi_name = 'order_count' AND anomaly_flag = -1 AND week_start_date >= DATE '2001-08-01' - 7 * 200")
def anomaly_recent(t: Tables) -> DataFrame:
    """The fitted timeline as its reader shows it: anomalous weeks of one KPI up to a day."""
    return st.anomaly_timeline(_anomalies(t), [" Order_Count"], F.lit(date(2001, 8, 1)), 200).select(*ANOMALY_COLUMNS)
