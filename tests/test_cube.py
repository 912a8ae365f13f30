"""Bitmap counts, day cubes, and WHY rows over each signal's own window."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kpivane.functions.periods import Window
from kpivane.operators import cube as cb
from kpivane.operators import why as wy
from kpivane.operators.model import Dimension, Distinct, Kpi, Ratio, Rows, Star, Total
from kpivane.operators.query import kpis_long
from kpivane.operators.snapshot import snapshot
from kpivane.plans.retail import APRIL, DEFINITIONS, ORDERS, STARS
from kpivane.sources.config import Job
from kpivane.streaming.sweep import explain_new_signals, ledger_rows

FACTS = "d date, k bigint, c string, v double"
STAR = Star(
    "s", "facts", "d", dimensions=(Dimension("c", "c"), Dimension("odd", "cast(k % 2 as string)")),
    kpis=(Kpi("total", Total("v"), depends_on=("n",)), Kpi("n", Rows()), Kpi("mean", Ratio(Total("v"), Rows("v > 0"))), Kpi("keys", Distinct("k")),
          Kpi("plain_keys", Distinct("k", bitmaps=False))))
NAMES = ("total", "n", "mean", "keys")


def facts(spark, rows):
    frame = spark.createDataFrame(rows, FACTS)
    return lambda _name: frame


ROWS = [
    (date(2024, 1, 1), 1, "x", 10.0), (date(2024, 1, 1), 1, "y", 5.0), (date(2024, 1, 2), 40_000, "x", None), (date(2024, 1, 3), -3, "x", 2.5),
    (date(2024, 1, 3), 32_768, None, 7.0), (date(2024, 2, 2), 1, "x", 1.0), (date(2024, 2, 3), None, "x", 4.0), (None, 9, "x", 100.0),
    (date(2024, 2, 9), 2**40, "y", 3.0), (date(2024, 2, 9), 0, "y", -3.0),
]


def values(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_bitmaps_count_like_keys(spark):
    tables = facts(spark, ROWS)
    both = kpis_long(STAR, tables, ["keys", "total"], ["c", "odd", "SELF"])
    plain = kpis_long(STAR, tables, ["plain_keys", "total"], ["c", "odd", "SELF"])
    shown = ("dimension", "dimension_value", "kpi_value")
    assert values(both.where("kpi_name = 'keys'"), *shown) == values(plain.where("kpi_name = 'plain_keys'"), *shown)
    assert values(both.where("kpi_name = 'total'"), *shown) == values(plain.where("kpi_name = 'total'"), *shown)
    assert "__key" not in both._jdf.queryExecution().toString()


def test_cube_windows_equal_the_scan(spark, tables):
    kpis, dims = ["order_value", "order_count", "avg_order_value", "customers"], ["segment", "priority", "SELF"]
    features = ["mom_growth_pct", "yoy_growth_pct", "acceleration"]
    cube = cb.day_cube(ORDERS, tables, kpis, cb.cube_sets(dims))
    columns = ("kpi_name", "dimension", "dimension_value", "feature_name", "kpi_value", "prior_value", "feature_value")
    scanned = values(snapshot(ORDERS, tables, kpis, dims, APRIL, features), *columns)
    assert values(cb.cube_snapshot(cube, ORDERS, kpis, dims, APRIL, features), *columns) == scanned and scanned


def test_cube_of_odd_rows(spark):
    cube = cb.day_cube(STAR, facts(spark, ROWS), NAMES, cb.cube_sets(["c", "SELF"], [("c", "odd")]))
    whole = cb.merged_values(cb.of_sets(cube, [()]), STAR, NAMES, ["set"], {"all": None, "jan": Window(date(2024, 1, 1), date(2024, 1, 31)).covers(F.col("day")),
                                                                        "none": F.lit(False)}).first()
    assert (whole["total__all"], whole["n__all"], whole["keys__all"]) == (29.5, 9.0, 6.0)
    assert (whole["total__jan"], whole["n__jan"], whole["keys__jan"], whole["mean__jan"]) == (24.5, 5.0, 4.0, 24.5 / 4)
    assert whole["total__none"] is None and whole["keys__none"] is None
    by_c = cb.merged_values(cb.of_sets(cube, [("c",)]), STAR, ["n"], ["c"], {"0": None})
    assert values(by_c, "c", "n__0") == [("x", 5.0), ("y", 3.0), (None, 1.0)]
    empty = cb.day_cube(STAR, facts(spark, []), NAMES, cb.cube_sets(["c", "SELF"]))
    assert empty.count() == 0
    with pytest.raises(ValueError, match="distinct"):
        cb.day_cube(STAR, facts(spark, ROWS), ["plain_keys"], [("c",)])


def test_few_keys_of_many_take_little_room(spark):
    rows = [(date(2024, 1, 1 + i % 20), (i * 2_654_435_761 + 63) % 5_000_000 - 9, "xyz"[i % 3], 1.0) for i in range(600)]
    cube = cb.day_cube(STAR, facts(spark, rows), NAMES, cb.cube_sets(["c", "SELF"]))
    assert "binary" not in {f.dataType.simpleString() for f in cube.schema}
    assert "SortAggregate" not in cube._jdf.queryExecution().executedPlan().toString()
    whole = cb.merged_values(cube, STAR, ["keys"], ["set", "c"], {"all": None, "first": F.col("day") == F.lit("2024-01-01").cast("date")})
    keys = {(s, c): {r[1] for r in rows if c in (None, r[2])} for s, c in (("", None), ("c", "x"), ("c", "y"), ("c", "z"))}
    first = {(s, c): {r[1] for r in rows if c in (None, r[2]) and r[0].day == 1} for s, c in keys}
    assert {(r["set"], r["c"]): (r["keys__all"], r["keys__first"]) for r in whole.collect()} == {k: (len(keys[k]), len(first[k]) or None) for k in keys}


def folders(path):
    return {name: sorted(os.listdir(f"{path}/{name}")) for name in os.listdir(path) if name.startswith("part=")}


def test_refresh_touches_changed_days_only(spark, tmp_path):
    path, rows = str(tmp_path / "cube"), [*ROWS, (date(2023, 12, 5), 1, "x", 1.0)]
    stored = cb.StoredCube(spark, path, STAR, NAMES, cb.cube_sets(["c", "SELF"]))
    stored.create(facts(spark, rows))
    before = folders(path)
    assert stored.refresh(facts(spark, list(reversed(rows)))) == [] and folders(path) == before
    changed = [r for r in rows if r[0] != date(2024, 1, 2)] + [(date(2024, 2, 2), 5, "z", 6.0), (date(2024, 3, 1), 5, "z", 6.0)]
    days = [date(2024, 1, 2), date(2024, 2, 2), date(2024, 3, 1)]
    # Facts of other days are not read for a refresh of given days: here they are wrong, and stay as they were.
    wrong = [r if r[0] in days else (r[0], 77, "w", 1.0) for r in changed]
    assert stored.refresh(facts(spark, wrong), days) == days
    after = folders(path)
    assert {n for n in after if after[n] != before.get(n)} == {"part=2024-01-01", "part=2024-02-01", "part=2024-03-01"} and set(before) <= set(after)
    parts = ("day", "set", "c", *[p.name for p in cb.cube_parts(STAR, NAMES)])
    fresh = cb.day_cube(STAR, facts(spark, changed), NAMES, cb.cube_sets(["c", "SELF"]))
    assert values(stored.read(), *parts) == values(fresh, *parts)
    assert stored.refresh(facts(spark, changed)) == []
    assert stored.refresh(facts(spark, rows)) == days and stored.refresh(facts(spark, rows)) == []


SIGNALS = ("signal_id string, kpi_name string, dimension string, dimension_value string, signal_name string, feature_name string, operator string, "
           "threshold_value double, job_id int, period_start date, period_end date, kpi_query string")


def signal(number, kpi, dimension, member, name, feature, operator, threshold, job, window):
    start, end = window or (None, None)
    text = f"window: {start} to {end}" if window else None
    return (f"{number:04d}", kpi, dimension, member, name, feature, operator, threshold, job, start, end, text)


def mixed(spark):
    from kpivane.functions.periods import window_text
    rows = [
        signal(1, "order_value", "segment", "BUILDING", "monthly_growth", "mom_growth_pct", "gt", -1000.0, 1, (date(1998, 4, 1), date(1998, 4, 30))),
        signal(2, "order_value", "segment", "BUILDING", "monthly_growth", "mom_growth_pct", "gt", -1000.0, 1, (date(1997, 6, 1), date(1997, 6, 30))),
        signal(3, "order_value", "segment", "BUILDING", "monthly_growth", "mom_growth_pct", "gt", -1000.0, 2, (date(1997, 6, 1), date(1997, 6, 30))),
        signal(4, "order_value", "segment", "BUILDING", "monthly_growth", "mom_growth_pct", "gt", -1000.0, 3, (date(1998, 4, 1), date(1998, 4, 30))),
        signal(5, "order_value", "segment", "BUILDING", "monthly_growth", "z_score", "gt", 0.0, 1, (date(1998, 4, 1), date(1998, 4, 30))),
        signal(6, "nothing", "segment", "BUILDING", "monthly_growth", "mom_growth_pct", "gt", 0.0, 1, None),
        signal(7, "order_value", "ALL", "ALL", "monthly_growth", "mom_growth_pct", "gt", 0.0, 1, None),
        signal(8, "order_value", "colour", "red", "monthly_growth", "mom_growth_pct", "gt", 0.0, None, None),
        signal(9, "order_value", "segment", "BUILDING", "monthly_growth", "mom_growth_pct", "gt", 1e9, 1, (date(1998, 4, 1), date(1998, 4, 30))),
        signal(10, "quantity", "brand", "Brand#11", "monthly_growth", "mom_growth_pct", "gt", -1000.0, 1, (date(1998, 4, 1), date(1998, 4, 30))),
    ]
    frame = spark.createDataFrame(rows, SIGNALS)
    return frame.withColumn("kpi_query", F.when(F.col("kpi_query").isNotNull(), window_text(F.col("period_start"), F.col("period_end"))))


JOBS = [Job(1, "order_value", ("segment",), ("monthly_growth",)),
        Job(2, "order_value", ("segment",), ("monthly_growth",), period_start=date(1998, 4, 1), period_end=date(1998, 4, 30)),
        Job(3, "order_value", ("segment",), ("monthly_growth",), filters=(("status", ("P",)),))]
RUN = datetime(1998, 5, 1)


def explained(batch, tables):
    return wy.explain_signals(batch, STARS, tables, JOBS, DEFINITIONS, F.lit(date(1998, 4, 15)), F.lit(RUN))


def test_each_signal_over_its_own_window(spark, tables):
    signals = mixed(spark)
    whys = explained(signals, tables).drop("run_timestamp")
    rows = {r.signal_id: r.n for r in whys.groupBy("signal_id").agg(F.count("*").alias("n")).collect()}
    assert set(rows) == {"0001", "0002", "0003", "0004", "0010"}
    periods = {(r.signal_id, r.period) for r in whys.collect()}
    assert {p for p in periods if p[0] != "0010"} == {
        ("0001", "1998-04-01 to 1998-04-30"), ("0002", "1997-06-01 to 1997-06-30"), ("0003", "1998-04-01 to 1998-04-30"), ("0004", "1998-04-01 to 1998-04-30")}
    shown = [c for c in whys.columns if c not in ("why_id", "signal_id")]
    # One window at a time gives the same rows, with and without the job's filter.
    for number, window, filters in (("0001", APRIL, {}), ("0002", Window(date(1997, 6, 1), date(1997, 6, 30)), {}), ("0004", APRIL, {"status": ["P"]})):
        alone = wy.explain(signals.where(F.col("signal_id") == number).withColumn("threshold2", F.lit(None).cast("double")), ORDERS, tables,
                           ["order_value"], ["segment"], window, ["mom_growth_pct"], F.lit(RUN), filters)
        assert values(whys.where(F.col("signal_id") == number), *shown) == values(alone, *shown)
    reasons = {r.signal_id: r.reason for r in wy.unexplained(signals, whys, STARS).collect()}
    assert set(reasons) == {f"{i:04d}" for i in (5, 6, 7, 8, 9)} and len(set(reasons.values())) == 5
    none = explained(signals.where("signal_id = 'x'"), tables)
    assert none.count() == 0 and none.columns == list(wy.WHY_COLUMNS)


def test_sweep_of_mixed_windows_and_its_ledger(spark, tables, tmp_path):
    source, output = str(tmp_path / "signals"), str(tmp_path / "swept")
    signals = mixed(spark)
    signals.repartition(2, "signal_id").write.parquet(source)

    def sweep():
        explain_new_signals(spark, source, output, lambda batch: explained(batch, tables), signals.schema, 1,
                            lambda fresh, whys: wy.unexplained(fresh, whys, STARS))
        done = sorted(r.signal_id for r in ledger_rows(spark, f"{output}/ledger").collect())
        return done, sorted(r.why_id for r in spark.read.parquet(f"{output}/whys").collect())

    first = sweep()
    assert first[0] == [f"{i:04d}" for i in range(1, 11)] and len(set(first[1])) == len(first[1]) > 0
    assert sweep() == first
    more = signals.where("signal_id in ('0001', '0006')").unionByName(signals.where("signal_id = '0002'").withColumn("signal_id", F.lit("ab12")))
    more.coalesce(1).write.mode("append").parquet(source)
    second = sweep()
    assert second[0] == [*first[0], "ab12"] and len(second[1]) > len(first[1])
    part = ledger_rows(spark, f"{output}/ledger", spark.createDataFrame([("ab99",)], "signal_id string"))
    assert [r.signal_id for r in part.collect()] == ["ab12"]
