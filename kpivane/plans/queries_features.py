"""Series, cross-section and snapshot features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numbers import pct_change
from ..functions.periods import Window, week_start
from ..operators import features as ft
from ..operators.signals import feature_table
from ..operators.snapshot import snapshot
from ..sources.tables import Tables
from . import sql as q
from .registry import query
from .retail import APRIL, EVENTS, LINES, ORDERS

SERIES_DIMS = ("segment", "priority", "SELF")
_KEY = "PARTITION BY dimension, dimension_value ORDER BY period_start"
_SERIES = f"""lng AS (
  SELECT 'segment' AS dimension, c_mktsegment AS dimension_value, o_orderdate, o_totalprice, o_orderstatus, o_orderkey FROM os UNION ALL
  SELECT 'priority', o_orderpriority, o_orderdate, o_totalprice, o_orderstatus, o_orderkey FROM os UNION ALL
  SELECT 'SELF', 'ALL', o_orderdate, o_totalprice, o_orderstatus, o_orderkey FROM os)"""


def _series(kpi: str = "order_value", bucket: str = "month") -> str:
    return f"""WITH {q.OS}, {_SERIES},
ser AS (SELECT '{kpi}' AS kpi_name, dimension, dimension_value,
  CAST(date_trunc('{bucket}', o_orderdate) AS DATE) AS period_start, {q.order_kpi(kpi)} AS kpi_value
  FROM lng GROUP BY 2, 3, 4)"""


def series(t: Tables, kpi: str = "order_value") -> DataFrame:
    """Monthly series of one KPI by segment, by priority and in total."""
    return ft.kpi_series(ORDERS, t, [kpi], SERIES_DIMS)


def with_feature(t: Tables, name: str, function, kpi: str = "order_value", **params) -> DataFrame:
    return ft.add_series_features(series(t, kpi), {name: (function, params)})


def _feature(name: str, expr: str, kpi: str = "order_value", mean: bool = False) -> str:
    shown = q.r2(expr) if mean else f"round({expr}, 2)"
    return f"{_series(kpi)}\nSELECT *, {shown} AS {name} FROM ser"


def _lag(n: int = 1) -> str:
    return f"lag(kpi_value, {n}) OVER ({_KEY})"


@query("kpi_monthly_series", f"{_series()}\nSELECT * FROM ser WHERE period_start >= DATE '1998-04-01'")
def kpi_monthly_series(t: Tables) -> DataFrame:
    return series(t).where(F.col("period_start") >= F.lit(APRIL.start))


@query("feat_growth_pct", _feature("growth_pct", q.pct("kpi_value", _lag(2))))
def feat_growth_pct(t: Tables) -> DataFrame:
    return with_feature(t, "growth_pct", ft.growth_pct, periods=2)


@query("feat_mom", _feature("mom_growth_pct", q.pct("kpi_value", _lag())))
def feat_mom(t: Tables) -> DataFrame:
    return with_feature(t, "mom_growth_pct", ft.growth_pct)


@query("feat_wow", f"{_series(bucket='week')}\nSELECT *, round({q.pct('kpi_value', _lag())}, 2) AS wow_growth_pct FROM ser")
def feat_wow(t: Tables) -> DataFrame:
    weekly = ft.kpi_series(ORDERS, t, ["order_value"], SERIES_DIMS, bucket=week_start)
    return ft.add_series_features(weekly, {"wow_growth_pct": (ft.growth_pct, {})})


@query("feat_qoq", _feature("qoq_growth_pct", q.pct("kpi_value", _lag(3))))
def feat_qoq(t: Tables) -> DataFrame:
    return with_feature(t, "qoq_growth_pct", ft.growth_pct, periods=3)


@query("feat_yoy", _feature("yoy_growth_pct", q.pct("kpi_value", _lag(12))))
def feat_yoy(t: Tables) -> DataFrame:
    return with_feature(t, "yoy_growth_pct", ft.growth_pct, periods=12)


def _strict(name: str, grain: str, value: str) -> str:
    """Calendar comparison as a self join on the exact earlier period."""
    step = {"month": "1 MONTH", "quarter": "3 MONTH", "year": "12 MONTH"}[grain]
    return f"""{_series()}, p AS (
SELECT kpi_name, dimension, dimension_value, CAST(date_trunc('{grain}', period_start) AS DATE) AS period_start, max(kpi_value) AS kpi_value
FROM ser WHERE NOT (dimension_value IN ('BUILDING', '1-URGENT') AND month(period_start) IN (3, 7)) GROUP BY 1, 2, 3, 4)
SELECT a.*, round({value}, 2) AS {name} FROM p a LEFT JOIN p b ON a.dimension = b.dimension
 AND a.dimension_value = b.dimension_value AND b.period_start = CAST(a.period_start - INTERVAL {step} AS DATE)"""


def _gappy(t: Tables, bucket: str) -> DataFrame:
    """The series with two months missing for two members, at one value per bucket."""
    gap = F.col("dimension_value").isin("BUILDING", "1-URGENT") & F.month("period_start").isin(3, 7)
    start = F.date_trunc(bucket, "period_start").cast("date")
    return (series(t).where(~gap).groupBy("kpi_name", "dimension", "dimension_value", start.alias("period_start"))
            .agg(F.max("kpi_value").alias("kpi_value")))


@query("feat_strict_mom", _strict("growth_pct", "month", q.pct("a.kpi_value", "b.kpi_value")))
def feat_strict_mom(t: Tables) -> DataFrame:
    return ft.add_series_features(_gappy(t, "month"), {"growth_pct": (ft.strict_growth, {"grain": "month"})})


@query("feat_strict_qoq", _strict("growth_pct", "quarter", q.pct("a.kpi_value", "b.kpi_value")))
def feat_strict_qoq(t: Tables) -> DataFrame:
    return ft.add_series_features(_gappy(t, "quarter"), {"growth_pct": (ft.strict_growth, {"grain": "quarter"})})


@query("feat_strict_yoy", _strict("growth_abs", "year", "a.kpi_value - b.kpi_value"))
def feat_strict_yoy(t: Tables) -> DataFrame:
    return ft.add_series_features(
        _gappy(t, "year"), {"growth_abs": (ft.strict_growth, {"grain": "year", "absolute": True})})


@query("feat_strict_acceleration", f"""WITH base AS ({_strict("g", "month", q.pct("a.kpi_value", "b.kpi_value")).replace("round(", "(").replace(", 2) AS g", ") AS g")})
SELECT kpi_name, dimension, dimension_value, period_start, kpi_value,
  round(g - lag(g) OVER ({_KEY}), 2) AS acceleration FROM base""")
def feat_strict_acceleration(t: Tables) -> DataFrame:
    return ft.add_strict_acceleration(_gappy(t, "month"))


@query("feat_pp_growth", _feature("growth_pct", f"{q.scale100('kpi_value')} - {q.scale100(_lag())}", "finished_rate"))
def feat_pp_growth(t: Tables) -> DataFrame:
    """Percentage-point growth of a rate."""
    return with_feature(t, "growth_pct", ft.growth_pct, "finished_rate", points=True)


@query("feat_growth_abs", _feature("growth_abs", f"kpi_value - {_lag()}"))
def feat_growth_abs(t: Tables) -> DataFrame:
    return with_feature(t, "growth_abs", ft.growth_abs)


@query("feat_acceleration", f"""{_series()}, g AS (SELECT *, {q.pct('kpi_value', _lag())} AS gr FROM ser)
SELECT * EXCLUDE (gr), round(gr - lag(gr) OVER ({_KEY}), 2) AS acceleration FROM g""")
def feat_acceleration(t: Tables) -> DataFrame:
    return with_feature(t, "acceleration", ft.acceleration)


@query("feat_acceleration_abs", f"""{_series()}, g AS (SELECT *, kpi_value - {_lag(2)} AS gr FROM ser)
SELECT * EXCLUDE (gr), round(gr - lag(gr) OVER ({_KEY}), 2) AS acceleration_abs FROM g""")
def feat_acceleration_abs(t: Tables) -> DataFrame:
    return with_feature(t, "acceleration_abs", ft.acceleration_abs, periods=2)


def _mean(frame: str) -> str:
    return (f"(CAST(sum(CAST(kpi_value AS DECIMAL(28,8))) OVER ({_KEY} {frame}) AS DOUBLE)"
            f" / count(kpi_value) OVER ({_KEY} {frame}))")


def _range_avg(months: int) -> str:
    return _mean(f"RANGE BETWEEN INTERVAL {months} MONTH PRECEDING AND CURRENT ROW")


def _rows(fn: str, n: int) -> str:
    frame = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return _mean(frame) if fn == "avg" else f"{fn}(kpi_value) OVER ({_KEY} {frame})"


@query("feat_rolling_avg", _feature("rolling_avg", _range_avg(3), mean=True))
def feat_rolling_avg(t: Tables) -> DataFrame:
    return with_feature(t, "rolling_avg", ft.rolling_avg, months=3)


@query("feat_rolling_avg_6m", _feature("rolling_avg_6m", _rows("avg", 6), mean=True))
def feat_rolling_avg_6m(t: Tables) -> DataFrame:
    return with_feature(t, "rolling_avg_6m", ft.rolling_rows_avg, window=6)


@query("feat_rolling_avg_12m", _feature("rolling_avg_12m", _range_avg(12), mean=True))
def feat_rolling_avg_12m(t: Tables) -> DataFrame:
    return with_feature(t, "rolling_avg_12m", ft.rolling_avg, days=365)


@query("feat_std_dev", _feature("std_dev", _rows("stddev_samp", 6)))
def feat_std_dev(t: Tables) -> DataFrame:
    return with_feature(t, "std_dev", ft.std_dev, window=6)


@query("feat_std_dev_3m", _feature("std_dev_3m", _rows("stddev_samp", 3)))
def feat_std_dev_3m(t: Tables) -> DataFrame:
    return with_feature(t, "std_dev_3m", ft.std_dev, window=3)


@query("feat_kpi_vs_rolling", _feature("kpi_vs_rolling_avg_pct", f"(kpi_value / nullif({_rows('avg', 3)}, 0) - 1) * 100"))
def feat_kpi_vs_rolling(t: Tables) -> DataFrame:
    return with_feature(t, "kpi_vs_rolling_avg_pct", ft.vs_rolling_avg, window=3)


@query("feat_cumulative_sum", f"""{_series()}, h AS (SELECT * REPLACE (CASE WHEN month(period_start) = 5 THEN NULL ELSE kpi_value END AS kpi_value) FROM ser)
SELECT *, CASE WHEN kpi_value IS NOT NULL THEN round(CAST(sum(CAST(kpi_value AS DECIMAL(28,4))) OVER ({_KEY} ROWS UNBOUNDED PRECEDING) AS DOUBLE), 2) END AS cumulative_sum FROM h""")
def feat_cumulative_sum(t: Tables) -> DataFrame:
    """Running sum over a series whose May values are missing."""
    holes = series(t).withColumn("kpi_value", F.when(F.month("period_start") != 5, F.col("kpi_value")))
    return ft.add_series_features(holes, {"cumulative_sum": (ft.cumulative_sum, {})})


@query("feat_seasonality", _feature("seasonality_index", f"kpi_value / nullif({_rows('avg', 12)}, 0)"))
def feat_seasonality(t: Tables) -> DataFrame:
    return with_feature(t, "seasonality_index", ft.seasonality)


@query("feat_z_score_rolling", _feature(
    "z_score", f"CASE WHEN {_rows('count', 6)} >= 2 THEN (kpi_value - {_rows('avg', 6)}) / nullif({_rows('stddev_samp', 6)}, 0) END"))
def feat_z_score_rolling(t: Tables) -> DataFrame:
    return with_feature(t, "z_score", ft.rolling_z_score, window=6)


@query("feat_benchmark_variance", f"""{_series()}, b AS (SELECT month(period_start) AS m, CASE WHEN month(period_start) = 2 THEN 0.0 ELSE round(CAST(sum(CAST(kpi_value AS DECIMAL(28,8))) AS DOUBLE) / count(*), 2) END AS benchmark
FROM ser WHERE dimension = 'SELF' GROUP BY 1)
SELECT ser.*, benchmark, round({q.pct('kpi_value', 'benchmark')}, 2) AS benchmark_variance,
  round(kpi_value - benchmark, 2) AS benchmark_gap FROM ser LEFT JOIN b ON m = month(period_start)""")
def feat_benchmark_variance(t: Tables) -> DataFrame:
    """Against each calendar month's mean total; February's benchmark is zero and gives NULL."""
    base = series(t)
    month = F.month("period_start")
    bench = (base.where("dimension = 'SELF'").groupBy(month.alias("m"))
             .agg(F.when(month == 2, 0.0).otherwise(F.round(F.sum(F.col("kpi_value").cast("decimal(28,8)")).cast("double") / F.count("kpi_value"), 2)).alias("benchmark")))
    joined = base.join(bench, month == F.col("m"), "left").drop("m")
    v, b = F.col("kpi_value"), F.col("benchmark")
    return joined.withColumns({
        "benchmark_variance": F.round(ft.benchmark_variance(v, b), 2),
        "benchmark_gap": F.round(ft.benchmark_variance(v, b, as_percentage=False), 2),
    })


@query("feat_discount_depth", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL
  ELSE CAST(l_discount AS DOUBLE) END AS discount_depth, CAST(NULL AS DOUBLE) AS absent FROM lineitem""")
def feat_discount_depth(t: Tables) -> DataFrame:
    """A precomputed text column read as a number; an absent column gives NULL."""
    raw = t("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") % 5 == 0, "unknown").otherwise(F.col("l_discount").cast("string")).alias("depth"))
    return raw.select("l_orderkey", "l_linenumber", ft.pass_through(raw, "depth").alias("discount_depth"),
                      ft.pass_through(raw, "no_such_column").alias("absent"))


# --- cross-section ----------------------------------------------------------------------------


def _brand_series() -> str:
    return f"""WITH {q.LS}, ser AS (SELECT 'revenue' AS kpi_name, 'brand' AS dimension, p_brand AS dimension_value,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, {q.line_kpi('revenue')} AS kpi_value
  FROM ls GROUP BY 3, 4)"""


def brand_series(t: Tables) -> DataFrame:
    return ft.kpi_series(LINES, t, ["revenue"], ["brand"])


_RANK = """CASE WHEN count(kpi_value) OVER (PARTITION BY {p}) >= 2 AND kpi_value IS NOT NULL
  THEN CAST(rank() OVER (PARTITION BY {p} ORDER BY kpi_value {o} NULLS LAST) AS DOUBLE) END"""


def _rank_sql(part: str, order: str = "DESC") -> str:
    return _RANK.format(p=part, o=order)


@query("feat_rank", f"""{_brand_series()}
SELECT *, {_rank_sql('period_start')} AS rank FROM ser""")
def feat_rank(t: Tables) -> DataFrame:
    return ft.add_rank(brand_series(t)).drop("rank_pct")


@query("feat_rank_pct", f"""{_brand_series()}
SELECT *, round({_rank_sql('period_start', 'ASC')} / count(kpi_value) OVER (PARTITION BY period_start) * 100, 2) AS rank_pct FROM ser""")
def feat_rank_pct(t: Tables) -> DataFrame:
    return ft.add_rank(brand_series(t), ascending=True).drop("rank")


@query("feat_rank_members", f"""WITH s AS (SELECT o_custkey AS customer_id, CAST(date_trunc('year', o_orderdate) AS DATE) AS period_start,
  {q.order_kpi('order_count')} AS kpi_value FROM orders GROUP BY 1, 2)
SELECT *, {_rank_sql('period_start')} AS rank,
  round({_rank_sql('period_start')} / count(kpi_value) OVER (PARTITION BY period_start) * 100, 2) AS rank_pct FROM s""")
def feat_rank_members(t: Tables) -> DataFrame:
    """Every customer ranked by its orders of the year, with heavy ties."""
    year = F.trunc(F.col("o_orderdate").cast("date"), "year")
    counts = t("orders").groupBy(F.col("o_custkey").alias("customer_id"), year.alias("period_start")).agg(
        ORDERS.kpi("order_count").measure.over().alias("kpi_value"))
    return ft.add_rank(counts, within=["period_start"])


@query("feat_z_score", f"""{_brand_series()}
SELECT *, round((kpi_value - CAST(sum(CAST(kpi_value AS DECIMAL(28,8))) OVER (PARTITION BY period_start) AS DOUBLE) / count(*) OVER (PARTITION BY period_start))
  / nullif(stddev_samp(kpi_value) OVER (PARTITION BY period_start), 0), 2) AS z_score FROM ser""")
def feat_z_score(t: Tables) -> DataFrame:
    return ft.add_period_stats(brand_series(t)).drop("mix")


@query("feat_mix", f"""{_brand_series()}
SELECT *, round(kpi_value / nullif(CAST(sum(CAST(kpi_value AS DECIMAL(28,8))) OVER (PARTITION BY period_start) AS DOUBLE), 0) * 100, 2) AS mix FROM ser""")
def feat_mix(t: Tables) -> DataFrame:
    return ft.add_period_stats(brand_series(t)).drop("z_score")


@query("feat_self", f"""WITH {q.OS} SELECT kpi_name, 'SELF' AS dimension, 'ALL' AS dimension_value, round(v, 2) AS self_kpi_value FROM (
  SELECT 'order_value' AS kpi_name, {q.order_kpi('order_value', q.od(q.APRIL))} AS v FROM os UNION ALL
  SELECT 'finished_rate', {q.order_kpi('finished_rate', q.od(q.APRIL))} FROM os)""")
def feat_self(t: Tables) -> DataFrame:
    out = feature_table(ORDERS, t, ["order_value", "finished_rate"], ["portfolio"], APRIL, ["self_kpi_value"])
    return out.select("kpi_name", "dimension", "dimension_value", F.col("feature_value").alias("self_kpi_value"))


# --- snapshots --------------------------------------------------------------------------------


def _snap(kpis: dict[str, str], before: tuple[str, str], feature: str, change: str | None = None) -> str:
    """`kpis`: name to kind. One grouped query per dimension and window, joined on the member."""
    dims = q.pick(q.ORDER_COLUMNS, "priority", "segment", "nation")
    select = ", ".join(f"{q.order_kpi(k, q.od(s))} AS {k}_{n}" for k in kpis for n, s in (("c", q.APRIL), ("p", before)))
    parts = []
    for k, kind in kpis.items():
        c, p = f"{k}_c", f"{k}_p"
        value = {"points": f"{q.scale100(c)} - {q.scale100(p)}", "number": q.pct_abs(c, p)}[kind]
        if change == "abs" and kind == "number":
            value = f"{c} - {p}"
        parts.append(f"SELECT dimension, dimension_value, '{k}' AS kpi_name, '{feature}' AS feature_name, "
                     f"{c} AS kpi_value, {p} AS prior_value, round({value}, 2) AS feature_value FROM g")
    return (f"WITH {q.OS}, g AS ({q.by_each('os', dims, select)}) SELECT * FROM ({' UNION ALL '.join(parts)}) "
            "WHERE kpi_value IS NOT NULL AND feature_value IS NOT NULL")


_SNAP_KPIS = {"order_value": "number", "order_count": "number", "finished_rate": "points"}
_SNAP_DIMS = ("priority", "segment", "nation")


def _snapshot(t: Tables, feature: str, window: Window = APRIL) -> DataFrame:
    return snapshot(ORDERS, t, list(_SNAP_KPIS), _SNAP_DIMS, window, [feature])


@query("snap_wow", _snap(_SNAP_KPIS, ("1998-03-25", "1998-04-01"), "wow_growth_pct"))
def snap_wow(t: Tables) -> DataFrame:
    return _snapshot(t, "wow_growth_pct")


@query("snap_mom", _snap(_SNAP_KPIS, q.MARCH_30, "mom_growth_pct"))
def snap_mom(t: Tables) -> DataFrame:
    return _snapshot(t, "mom_growth_pct")


@query("snap_qoq", _snap(_SNAP_KPIS, ("1998-01-01", "1998-01-31"), "qoq_growth_pct"))
def snap_qoq(t: Tables) -> DataFrame:
    return _snapshot(t, "qoq_growth_pct")


@query("snap_yoy", _snap(_SNAP_KPIS, q.APRIL_97, "yoy_growth_pct"))
def snap_yoy(t: Tables) -> DataFrame:
    return _snapshot(t, "yoy_growth_pct")


@query("snap_growth_abs", _snap(_SNAP_KPIS, q.MARCH_30, "growth_abs", "abs"))
def snap_growth_abs(t: Tables) -> DataFrame:
    return _snapshot(t, "growth_abs")


@query("snap_vs_baseline", _snap(_SNAP_KPIS, ("1998-01-01", "1998-04-01"), "kpi_vs_rolling_avg_pct"))
def snap_vs_baseline(t: Tables) -> DataFrame:
    """Against the measure over the whole three months before."""
    return _snapshot(t, "kpi_vs_rolling_avg_pct")


def _accel(kpis: dict[str, str]) -> str:
    dims = q.pick(q.ORDER_COLUMNS, "priority", "segment", "nation")
    spans = (("c", q.APRIL), ("p", q.MARCH_30), ("b", q.FEBRUARY_28))
    select = ", ".join(f"{q.order_kpi(k, q.od(s))} AS {k}_{n}" for k in kpis for n, s in spans)
    parts = []
    for k, kind in kpis.items():
        c, p, b = f"{k}_c", f"{k}_p", f"{k}_b"
        s = q.scale100
        points = f"({s(c)} - {s(p)}) - ({s(p)} - {s(b)})"
        for feature, number in (("acceleration", f"{q.pct_abs(c, p)} - {q.pct_abs(p, b)}"),
                                ("acceleration_abs", f"({c} - {p}) - ({p} - {b})")):
            value = points if kind == "points" else number
            parts.append(f"SELECT dimension, dimension_value, '{k}' AS kpi_name, '{feature}' AS feature_name, "
                         f"{c} AS kpi_value, {p} AS prior_value, round({value}, 2) AS feature_value FROM g")
    return (f"WITH {q.OS}, g AS ({q.by_each('os', dims, select)}) SELECT * FROM ({' UNION ALL '.join(parts)}) "
            "WHERE kpi_value IS NOT NULL AND feature_value IS NOT NULL")


@query("snap_acceleration", _accel(_SNAP_KPIS))
def snap_acceleration(t: Tables) -> DataFrame:
    """April against March against February, relative, absolute and in points."""
    return snapshot(ORDERS, t, list(_SNAP_KPIS), _SNAP_DIMS, APRIL, ["acceleration", "acceleration_abs"])


@query("custom_feature", f"""WITH s AS (SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS period_start,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS kpi_value FROM events GROUP BY 1, 2)
SELECT 'event_value' AS kpi_name, 'event_type' AS dimension, event_type AS dimension_value, period_start, kpi_value,
  round({q.pct('kpi_value', "max(kpi_value) OVER (PARTITION BY event_type ORDER BY period_start ROWS UNBOUNDED PRECEDING)")}, 2) AS drawdown
FROM s""")
def custom_feature(t: Tables) -> DataFrame:
    """A user-registered feature: distance from the highest value so far."""
    def drawdown(v, s):
        return pct_change(v, F.max(v).over(s.by_row.rowsBetween(W.unboundedPreceding, 0)))

    ft.register_feature("drawdown", drawdown)
    weekly = ft.kpi_series(EVENTS, t, ["event_value"], ["event_type"], bucket=week_start)
    return ft.add_series_features(weekly, ["drawdown"])


@query("custom_python_feature", f"""{_series()}
SELECT *, median(kpi_value) OVER ({_KEY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS median_3 FROM ser""")
def custom_python_feature(t: Tables) -> DataFrame:
    """A user-supplied pandas feature, per member."""
    def median(part: pd.DataFrame) -> pd.Series:
        return part["kpi_value"].rolling(3, min_periods=1).median()

    return ft.apply_python_feature(series(t), "median_3", median)
