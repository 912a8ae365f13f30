"""Stars, KPIs, signal definitions and jobs over the TPC-H-like tables."""

from __future__ import annotations

from datetime import date

from ..functions.periods import Window
from ..operators.model import Dimension, Distinct, Kpi, Link, Ratio, Rows, Star, Total
from ..sources.config import Job, SignalDef

CUSTOMER = Link("customer", "o_custkey", "c_custkey", ("c_mktsegment", "c_nationkey"))
NATION = Link("nation", "c_nationkey", "n_nationkey", ("n_name", "n_regionkey"))
REGION = Link("region", "n_regionkey", "r_regionkey", ("r_name",))
PART = Link("part", "l_partkey", "p_partkey", ("p_brand", "p_type"))
SUPPLIER = Link("supplier", "l_suppkey", "s_suppkey", ("s_name", "s_nationkey"))

ORDER_DIMS = ("priority", "status", "segment", "nation", "region")
LINE_DIMS = ("brand", "part_type", "return_flag", "line_status")

ORDERS = Star(
    name="orders_star", fact="orders", date_column="o_orderdate",
    links={"customer": CUSTOMER, "nation": NATION, "region": REGION},
    dimensions=(
        Dimension("priority", "o_orderpriority"),
        Dimension("status", "o_orderstatus"),
        Dimension("segment", "c_mktsegment", ("customer",)),
        Dimension("nation", "n_name", ("customer", "nation")),
        Dimension("region", "r_name", ("customer", "nation", "region")),
        Dimension("order_day", "o_orderdate", kind="date"),
        Dimension("customer_id", "o_custkey", kind="key"),
        Dimension("week", "cast(date_trunc('week', o_orderdate) as date)", kind="date"),
    ),
    kpis=(
        Kpi("order_value", Total("o_totalprice"), label="Order value", dimensions=ORDER_DIMS,
            depends_on=("order_count", "avg_order_value")),
        Kpi("order_count", Rows(), label="Orders", dimensions=ORDER_DIMS),
        Kpi("avg_order_value", Ratio(Total("o_totalprice"), Rows()), label="Average order value",
            dimensions=ORDER_DIMS),
        Kpi("finished_rate", Ratio(Rows("o_orderstatus = 'F'"), Rows()), format="percentage",
            label="Finished rate", points=True, dimensions=("priority", "segment", "nation", "region")),
        Kpi("customers", Distinct("o_custkey"), label="Active customers", dimensions=ORDER_DIMS),
    ),
)

LINES = Star(
    name="lines_star", fact="lineitem", date_column="l_shipdate", sources={"discount_depth": "avg_discount"},
    links={"part": PART, "supplier": SUPPLIER},
    dimensions=(
        Dimension("brand", "p_brand", ("part",)),
        Dimension("part_type", "p_type", ("part",)),
        Dimension("return_flag", "l_returnflag"),
        Dimension("line_status", "l_linestatus"),
        Dimension("supplier", "s_name", ("supplier",), kind="key"),
    ),
    kpis=(
        Kpi("revenue", Total("cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))", 4),
            label="Revenue", dimensions=LINE_DIMS, depends_on=("quantity", "avg_discount")),
        Kpi("quantity", Total("l_quantity"), label="Quantity", dimensions=LINE_DIMS),
        Kpi("line_count", Rows(), label="Lines", dimensions=LINE_DIMS),
        Kpi("avg_discount", Ratio(Total("l_discount"), Rows()), format="percentage", label="Average discount",
            dimensions=LINE_DIMS),
        Kpi("return_rate", Ratio(Rows("l_returnflag = 'R'"), Rows()), format="percentage", label="Return rate",
            points=True, dimensions=("brand", "part_type", "line_status")),
    ),
)

EVENTS = Star(
    name="events_star", fact="events", date_column="ts",
    dimensions=(Dimension("event_type", "event_type"), Dimension("user", "user_id", kind="key")),
    kpis=(
        Kpi("event_value", Total("value"), label="Event value", dimensions=("event_type",)),
        Kpi("event_count", Rows(), label="Events", dimensions=("event_type",)),
        Kpi("error_rate", Ratio(Rows("event_type = 'error'"), Rows()), format="percentage", points=True,
            dimensions=()),
    ),
)

STARS = (ORDERS, LINES, EVENTS)

APRIL = Window(date(1998, 4, 1), date(1998, 4, 30))
QUARTER = Window(date(1998, 4, 1), date(1998, 6, 30))
WEEK = Window(date(1998, 4, 6), date(1998, 4, 12))
YEARS = Window(date(1996, 1, 1), date(1999, 12, 31))

DEFINITIONS = (
    SignalDef("monthly_growth", "mom_growth_pct", "gt", 10.0, None, "info", top_n=3),
    SignalDef("monthly_degrowth", "mom_growth_pct", "lt", -10.0, None, "warning", top_n=2,
              overrides={"segment": -12.5}),
    SignalDef("band", "mom_growth_pct", "between", -2.0, 2.0, "info"),
    SignalDef("no_upper", "mom_growth_pct", "between", 5.0, None, "info"),
    SignalDef("odd_op", "mom_growth_pct", "xx", 0.0, None, "info"),
    SignalDef("yearly_growth", "yoy_growth_pct", "gte", 5.0, None, "info"),
    SignalDef("laggard", "rank_pct", "gte", 90.0, None, "warning"),
    SignalDef("outlier", "z_score", "gt", 1.0, None, "warning"),
    SignalDef("slowing", "acceleration", "lt", -15.0, None, "critical"),
    SignalDef("volatile", "std_dev", "gt", 0.0, None, "info"),
    SignalDef("weekly_growth", "wow_growth_pct", "gt", 5.0, None, "info"),
)

JOBS = (
    Job(1, "order_value", ("priority", "segment", "nation"), ("monthly_growth", "monthly_degrowth", "band", "no_upper", "odd_op")),
    Job(2, "return_rate", ("brand",), ("monthly_growth", "monthly_degrowth", "outlier")),
    Job(3, "order_count", ("SELF", "region"), ("yearly_growth", "laggard", "slowing")),
    Job(4, "quantity", ("brand",), ("monthly_growth",), is_active=False),
    Job(5, "revenue", ("brand", "part_type"), ("monthly_growth", "volatile"),
        filters=(("return_flag", ("A", "N")), ("colour", ("red",)))),
    Job(6, "finished_rate", ("nation",), ("monthly_growth", "week_spike")),
)

GROUPS = {
    "group1": ("order_value", "revenue"),
    "group2": ("order_count", "customers"),
    "group3": ("return_rate", "finished_rate", "order_value"),
}
