"""The query builder and the ad-hoc fetch."""

import contextlib
import io
from datetime import date, timedelta

import pytest

from kpivane.operators.fetch import apply_filters, parse_condition
from kpivane.operators.model import CatalogueError, Dimension, Kpi, Ratio, Rows, Star, Total, Value, is_self
from kpivane.operators.query import KpiQuery, group_values, kpis_long
from kpivane.plans.retail import APRIL, LINES, ORDERS, QUARTER
from kpivane.sources.config import check_catalogue
from kpivane.sources.tables import CatalogTables, save_bucketed

TOY = Star(
    "toy", "facts", "day", (Dimension("shop", "shop"), Dimension("day", "day", kind="date")),
    (Kpi("sales", Total("amount")), Kpi("lines", Rows()), Kpi("rate", Ratio(Rows("amount > 5"), Rows()), "percentage")),
)


@pytest.fixture(scope="module")
def toy(spark):
    rows = [("x", date(2026, 3, 1), 10.0), ("y", date(2026, 3, 1), 4.0), (None, date(2026, 3, 2), 2.5),
            ("x", date(2026, 3, 6), 1.0), ("z", date(2026, 3, 7), None)]
    frame = spark.createDataFrame(rows, "shop string, day date, amount double")
    return lambda _name: frame


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_exclusion_keeps_missing_members(toy):
    got = KpiQuery(TOY, toy).with_kpi("sales").group_by("shop").exclude("shop", ["x"]).to_df()
    assert rows(got) == rows_of([("y", 4.0), (None, 2.5)])


def rows_of(items):
    return sorted(items, key=repr)


def test_blank_groups_are_left_out(toy):
    got = KpiQuery(TOY, toy).with_kpi("sales").group_by("shop").to_df()
    assert "z" not in [r.shop for r in got.collect()]


def test_iso_text_becomes_a_day(toy):
    got = KpiQuery(TOY, toy).with_kpi("sales").member("day", ["2026-03-06T00:00:00"]).to_df()
    assert rows(got) == [(1.0,)]


def test_single_day_window(toy):
    day = date(2026, 3, 1)
    assert rows(KpiQuery(TOY, toy).with_kpi("sales").between(day, day).to_df()) == [(14.0,)]


def test_total_without_rows_is_null_and_left_out(toy):
    assert KpiQuery(TOY, toy).with_kpi("sales").pin("shop", "nobody").to_df().count() == 0


def test_builder_is_immutable(toy):
    base = KpiQuery(TOY, toy).with_kpi("sales")
    narrowed = base.pin("shop", "x")
    assert base.members == () and narrowed.members
    assert rows(narrowed.to_df()) == rows(narrowed.to_df())


def test_unknown_names_raise(toy):
    with pytest.raises(CatalogueError):
        KpiQuery(TOY, toy).with_kpi("profit")
    with pytest.raises(CatalogueError):
        KpiQuery(TOY, toy).group_by("planet")
    with pytest.raises(CatalogueError):
        KpiQuery(TOY, toy).to_df()
    with pytest.raises(ValueError):
        KpiQuery(TOY, toy).with_kpi("sales").having("like", 1)
    with pytest.raises(ValueError):
        KpiQuery(TOY, toy).with_kpi("sales").having("between", 1)


def test_broken_catalogue_is_refused():
    bad = Star("bad", "facts", "day", (Dimension("shop", "shop", ("nowhere",)),), (Kpi("a", Rows()),))
    with pytest.raises(CatalogueError):
        check_catalogue([bad])


def test_long_member_list_gives_the_same(toy, spark):
    few = KpiQuery(TOY, toy).with_kpi("sales").group_by("shop").member("shop", ["x", "y"]).to_df()
    many = KpiQuery(TOY, toy).with_kpi("sales").group_by("shop").member(
        "shop", ["x", "y", *[f"no{i}" for i in range(500)]]).to_df()
    assert rows(few) == rows(many)


@pytest.mark.parametrize("raw, parsed", [
    ("> 0", ("gt", 0.0, None)), (">= 100", ("gte", 100.0, None)), ("between 1 and 5", ("between", 1.0, 5.0)),
    ("7.5", ("eq", 7.5, None)), ("<> -2", ("ne", -2.0, None)), ("==3", ("eq", 3.0, None)),
    ({"op": "<", "value": 4}, ("lt", 4.0, None)), ({"op": "between", "value": 1, "value2": 2}, ("between", 1.0, 2.0)),
])
def test_conditions(raw, parsed):
    assert parse_condition(raw) == parsed


@pytest.mark.parametrize("raw", ["about 5", "> x", {"op": "like", "value": 1}, {"op": "between", "value": 1}, {"op": ">"}])
def test_bad_conditions(raw):
    with pytest.raises(ValueError):
        parse_condition(raw)


def test_filter_key_is_dimension_then_kpi_then_error(toy):
    query = apply_filters(KpiQuery(TOY, toy).with_kpi("sales"), {"shop": "x", "lines": ">= 1"})
    assert query.members and query.havings
    with pytest.raises(CatalogueError):
        apply_filters(query, {"colour": "red"})


def test_self_names():
    assert is_self(" total ") and is_self("(ALL)") and not is_self("region")


def test_self_group_and_grouping_of_null_members(toy):
    got = {(r.dimension, r.dimension_value): r.kpi_value for r in kpis_long(TOY, toy, ["sales"], ["shop", "SELF"]).collect()}
    assert got[("SELF", "ALL")] == 17.5 and got[("shop", None)] == 2.5


def test_ratio_is_zero_not_missing_when_nothing_matches(toy):
    got = {r.shop: r.kpi_value for r in KpiQuery(TOY, toy).with_kpi("rate").group_by("shop").to_df().collect()}
    assert got["y"] == 0.0 and got["x"] == 0.5


def plan(frame, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(tables):
    query = KpiQuery(ORDERS, tables, window=APRIL).with_kpi("order_value").group_by("priority").pin("status", "F")
    text = plan(query.to_df())
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    read = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "GreaterThanOrEqual(o_orderdate,1998-04-01" in pushed and "LessThan(o_orderdate,1998-05-01" in pushed
    assert "EqualTo(o_orderstatus,F)" in pushed
    assert "o_custkey" not in read and text.count("Scan parquet") == 2


def test_a_day_member_reaches_the_scan(tables):
    text = plan(KpiQuery(ORDERS, tables).with_kpi("order_value").member("order_day", ["1998-04-02"]).to_df())
    assert "GreaterThanOrEqual(o_orderdate,1998-04-02" in text


def test_many_dimensions_share_one_scan(tables):
    text = plan(kpis_long(LINES, tables, ["revenue", "quantity"], ["return_flag", "line_status", "SELF"], APRIL), "simple")
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 2
    assert text.rindex("Exchange hashpartitioning") > text.index("Expand")


def test_bucketed_tables_join_without_a_shuffle_of_the_fact(spark, tables, tmp_path):
    save_bucketed(tables("lineitem"), "lineitem", "l_partkey", 4, str(tmp_path / "lineitem"))
    save_bucketed(tables("part"), "part", "p_partkey", 4, str(tmp_path / "part"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = KpiQuery(LINES, CatalogTables(spark), window=APRIL).with_kpi("revenue").group_by("brand").to_df()
        plain = KpiQuery(LINES, tables, window=APRIL).with_kpi("revenue").group_by("brand").to_df()
        assert plan(stored, "simple").count("Exchange hashpartitioning") == 1
        assert plan(plain, "simple").count("Exchange hashpartitioning") == 3
        assert rows(stored) == rows(plain)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP TABLE lineitem")
        spark.sql("DROP TABLE part")


def test_steps_do_not_change_values(tables):
    """Adding up by all keys first gives what one step gives, distinct counts and windows included."""
    dims = ["priority", "segment", "SELF"]
    frame = KpiQuery(ORDERS, tables, dims=("priority", "segment")).filtered()
    values = [Value(f"{k}_{i}", ORDERS.kpi(k).measure, w) for k in ("order_value", "customers", "finished_rate", "avg_order_value")
              for i, w in enumerate((None, APRIL, QUARTER))]
    keys = {d: ORDERS.dimension(d).column() for d in dims[:2]}
    sets = [["priority"], ["segment"], ["priority", "segment"], []]
    one, two = (group_values(frame, ORDERS, keys, sets, values, compact=c) for c in (True, False))
    assert rows(one) == rows(two) and one.count() > 30
    text = plan(one, "simple")
    assert text.index("Expand") < text.rindex("Exchange hashpartitioning")


def test_long_member_lists_with_unreadable_days(spark, tables):
    days = [str(date(1995, 1, 1) + timedelta(days=i)) for i in range(400)]
    few = KpiQuery(ORDERS, tables).with_kpi("order_count").member("order_day", tuple(days[:3] + ["soon"])).to_df().first()
    many = KpiQuery(ORDERS, tables).with_kpi("order_count").member("order_day", tuple(days + ["soon"])).to_df().first()
    ranged = tables("orders").where("o_orderdate < date_add(date'1995-01-01', 400)").count()
    assert many[0] == ranged and few[0] <= many[0]
