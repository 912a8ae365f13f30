"""Day cubes: windows, series and refreshes that read stored days in place of the facts."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import month_start
from ..operators.cube import StoredCube, cube_series, cube_sets, cube_snapshot, merged_values, of_sets
from ..sources.stage import stage_root
from ..sources.tables import Tables
from . import sql as q
from .registry import query
from .retail import APRIL, ORDERS

KPIS = ("order_value", "order_count", "avg_order_value", "finished_rate", "customers")
DIMS = ("priority", "segment", "nation", "SELF")
REAL = ("priority", "segment", "nation")


def orders_cube(t: Tables) -> StoredCube:
    path = f"{stage_root(t.spark).rstrip('/')}/cube-{uuid4().hex}"
    return StoredCube(t.spark, path, ORDERS, KPIS, cube_sets(DIMS))


def _snap_sql() -> str:
    parts = []
    for kpi in KPIS:
        for feature, before in (("mom_growth_pct", q.MARCH_30), ("yoy_growth_pct", q.APRIL_97)):
            inner = q.by_each("os", q.pick(q.ORDER_COLUMNS, *REAL), f"{q.order_kpi(kpi, q.od(q.APRIL))} AS c, {q.order_kpi(kpi, q.od(before))} AS p", self_total=True)
            change = f"{q.scale100('c')} - {q.scale100('p')}" if kpi == "finished_rate" else q.pct_abs("c", "p")
            parts.append(f"SELECT '{kpi}' AS kpi_name, dimension, dimension_value, '{feature}' AS feature_name, c AS kpi_value, p AS prior_value, "
                         f"round({change}, 2) AS feature_value FROM ({inner})")
    return f"WITH {q.OS} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE kpi_value IS NOT NULL AND feature_value IS NOT NULL"


@query("snap_from_cube", _snap_sql())
def snap_from_cube(t: Tables) -> DataFrame:
    """Monthly and yearly growth of five KPIs, one a distinct count, from a stored cube."""
    stored = orders_cube(t)
    stored.create(t)
    return cube_snapshot(stored.read(), ORDERS, KPIS, DIMS, APRIL, ["mom_growth_pct", "yoy_growth_pct"])


def _months_sql() -> str:
    columns = {**q.pick(q.ORDER_COLUMNS, *REAL)}
    parts = []
    for kpi in KPIS:
        for d, c in [*columns.items(), ("SELF", "'ALL'")]:
            parts.append(f"SELECT '{kpi}' AS kpi_name, '{d}' AS dimension, {c} AS dimension_value, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, "
                         f"{q.order_kpi(kpi)} AS kpi_value FROM os GROUP BY 3, 4")
    return f"WITH {q.OS} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE kpi_value IS NOT NULL"


@query("series_from_cube", _months_sql())
def series_from_cube(t: Tables) -> DataFrame:
    """The monthly series of every member, from a stored cube."""
    stored = orders_cube(t)
    stored.create(t)
    return cube_series(stored.read(), ORDERS, KPIS, DIMS, month_start)


class Changed:
    """The tables as an earlier load had them: no orders after the cutoff, one status still open, one day not yet taken back."""

    def __init__(self, tables: Tables) -> None:
        self.tables = tables

    def __call__(self, name: str) -> DataFrame:
        frame = self.tables(name)
        if name != "orders":
            return frame
        open_then = (F.col("o_orderdate").cast("date") == F.lit("1998-04-15").cast("date")) & (F.col("o_orderkey") % 2 == 0)
        known = frame.where(F.col("o_orderdate") < F.lit("2001-06-01").cast("timestamp_ntz")).withColumn(
            "o_totalprice", F.when(open_then, F.lit(1.0)).otherwise(F.col("o_totalprice")))
        extra = known.where(F.col("o_orderdate").cast("date") == F.lit("1998-04-16").cast("date")).withColumn(
            "o_orderdate", F.lit("1990-01-01").cast("timestamp_ntz"))
        return known.unionByName(extra)


@query("cube_refresh", f"""WITH {q.OS}, d AS (SELECT CAST(o_orderdate AS DATE) AS day, c_mktsegment AS segment, {q.order_kpi('order_value')} AS order_value,
  {q.order_kpi('order_count')} AS order_count, {q.order_kpi('customers')} AS customers FROM os GROUP BY 1, 2),
odd AS (SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1998-04-15' AND o_orderkey % 2 = 0)
SELECT d.*, day >= DATE '2001-06-01' OR (day = DATE '1998-04-15' AND n > 0) AS replaced FROM d, odd""")
def cube_refresh(t: Tables) -> DataFrame:
    """A cube of an earlier load brought up to date: new, changed and vanished days are replaced, no others."""
    stored = orders_cube(t)
    stored.create(Changed(t))
    days = stored.refresh(t)
    fresh = F.col("day").isin(days) if days else F.lit(False)
    wide = merged_values(of_sets(stored.read(), [("segment",)]), ORDERS, ["order_value", "order_count", "customers"], ["day", "segment"], {"0": None})
    return wide.select("day", "segment", *[F.col(f"{k}__0").alias(k) for k in ("order_value", "order_count", "customers")], fresh.alias("replaced"))
