"""Thresholds, jobs, WHY rows, the sweep and the whole run."""

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kpivane.functions.periods import Window
from kpivane.operators import signals as sg
from kpivane.operators import why as wy
from kpivane.operators.signals import plan_jobs
from kpivane.plans import run
from kpivane.plans.queries_signals import BASE_JOBS, RUN_AT, SIGNAL_DIMS, SIGNAL_KPIS, stored_signals
from kpivane.plans.retail import APRIL, DEFINITIONS, JOBS, ORDERS, STARS
from kpivane.sources import config as cf
from kpivane.sources.config import Job, SignalDef
from kpivane.streaming.sweep import explain_new_signals


def fired(spark, value, *defs):
    values = spark.createDataFrame([("k", "d", "m", "f", 1.0, 1.0, value)],
                                   "kpi_name string, dimension string, dimension_value string, feature_name string, "
                                   "kpi_value double, prior_value double, feature_value double")
    return sorted(r.signal_name for r in sg.detect(values, cf.signal_defs_frame(spark, defs)).collect())


def test_operators_and_bounds(spark):
    defs = [
        SignalDef("lt", "f", "lt", 5.0), SignalDef("lte", "f", "lte", 5.0), SignalDef("gt", "calculate_f", "gt", 5.0),
        SignalDef("gte", "f", "gte", 5.0), SignalDef("low", "f", "between", 5.0, 9.0), SignalDef("high", "f", "between", 1.0, 5.0),
        SignalDef("open", "f", "between", 1.0, None), SignalDef("odd", "f", "xx", 0.0), SignalDef("other", "g", "gt", 0.0),
    ]
    assert fired(spark, 5.0, *defs) == ["gte", "high", "low", "lte"]
    assert fired(spark, 5.1, *defs) == ["gt", "gte", "low"]
    assert fired(spark, None, *defs) == []


def test_inline_rows_keep_values(spark):
    rows = [("it's \\ fine", None, {"a'b": 1.5}, ["x", "y"], True, date(2024, 1, 2), 7), (None, 2.5, {}, [], False, None, None)]
    ddl = "s string, d double, m map<string,double>, a array<string>, b boolean, t date, i int"
    got = [tuple(r) for r in cf.inline_rows(spark, rows, ddl).collect()]
    assert got == rows
    assert cf.inline_rows(spark, [], ddl).count() == 0


def test_worst_first_keeps_uncapped_rows(spark):
    rows = [("k", "d", f"m{i}", "s", op, float(i), n) for op, n in (("gt", 2), ("lt", 1), ("lte", None)) for i in range(5)]
    frame = spark.createDataFrame(
        [(k, d, m, s + o, o, v, n) for k, d, m, s, o, v, n in rows],
        "kpi_name string, dimension string, dimension_value string, signal_name string, operator string, feature_value double, top_n int")
    got = sorted((r.operator, r.feature_value) for r in sg.worst_first(frame, 2).collect())
    assert got == [("gt", 3.0), ("gt", 4.0), ("lt", 0.0)] + [("lte", float(i)) for i in range(5)]


def test_jobs_share_plans():
    defs = {d.signal_name: d for d in DEFINITIONS}
    plans = plan_jobs(STARS, JOBS, defs, APRIL)
    assert [(p.star.name, [j.job_id for j in p.jobs]) for p in plans] == [
        ("orders_star", [1, 3, 6]), ("lines_star", [2]), ("lines_star", [5])]
    assert dict(plans[2].filters) == {"return_flag": ("A", "N")}
    assert plan_jobs(STARS, [Job(9, "profit", ("brand",), ("band",))], defs, APRIL) == []
    assert plan_jobs(STARS, [Job(9, "revenue", ("brand",), ("no such signal",))], defs, APRIL) == []


def test_jobs_that_cannot_run_are_reported(spark, tables):
    bad = [Job(9, "profit", ("brand",), ("band",)), Job(10, "revenue", ("brand",), ("no such signal",))]
    errors = {r.job_id: r.error for r in sg.job_errors(spark, STARS, [*JOBS, *bad], DEFINITIONS).collect()}
    assert set(errors) == {9, 10} and "profit" in errors[9]
    assert sg.job_errors(spark, STARS, JOBS, DEFINITIONS).count() == 0
    every = sg.detect_jobs(spark, STARS, tables, [*JOBS, *bad], DEFINITIONS, APRIL, F.lit(datetime(2024, 5, 1)))
    assert every.count() == sg.detect_jobs(spark, STARS, tables, JOBS, DEFINITIONS, APRIL, F.lit(datetime(2024, 5, 1))).count()


def test_top_n_limits_a_run(spark, tables):
    defs = [replace(d, top_n=1) for d in DEFINITIONS]
    every, most = [sg.detect_jobs(spark, STARS, tables, JOBS, x, APRIL, F.lit(datetime(2024, 5, 1))) for x in (DEFINITIONS, defs)]
    groups = every.select("job_id", "kpi_name", "dimension", "signal_name").distinct().count()
    assert most.count() == groups < every.count()


def test_job_without_dimensions_and_bad_period(spark):
    jobs = spark.createDataFrame(
        [(1, "k", [], ["week_spike", " week_spike", ""], '{"period": {"start": "soon"}, "a": "x", "b": ["y", "z"], "c": {"d": 1}}', True),
         (2, "k", ["p", "q"], None, None, True), (3, "k", ["p"], [], "not json", False)],
        "job_id int, kpi_name string, dimensions array<string>, signals array<string>, raw_filters string, is_active boolean")
    got = cf.expand_jobs(jobs).orderBy("job_id", "dimension_name").collect()
    assert [(r.job_id, r.dimension_name) for r in got] == [(1, ""), (2, "p"), (2, "q")]
    assert got[0].filters == {"a": ["x"], "b": ["y", "z"]} and got[0].period_start is None
    assert got[0].signals == ["weekly_growth"] and got[1].filters == {}


def test_rows_are_stable_between_runs(spark, tables):
    one, two = ({r.signal_id for r in sg.detect_jobs(spark, [ORDERS], tables, BASE_JOBS, DEFINITIONS, APRIL, F.lit(RUN_AT)).collect()}
                for _ in range(2))
    assert one == two and one


def test_portfolio_signals_have_no_why_rows(tables):
    signals = stored_signals(tables)
    whys = explain(signals, tables)
    own = signals.where("dimension = 'SELF'").select("signal_id")
    assert own.count() > 0 and whys.join(own, "signal_id", "left_semi").count() == 0


def explain(signals, tables):
    return wy.explain(signals, ORDERS, tables, SIGNAL_KPIS, SIGNAL_DIMS, APRIL, ["mom_growth_pct", "yoy_growth_pct"], F.lit(RUN_AT))


def test_members_narrow_the_scan_without_changing_rows(spark, tables):
    signals = stored_signals(tables).where("dimension = 'segment' and job_id = 1")
    wide = wy.explain(signals, ORDERS, tables, ["order_value"], ["segment"], APRIL, ["mom_growth_pct"], F.lit(RUN_AT))
    members = signals.select("dimension_value")
    narrow = wy.explain(signals, ORDERS, tables, ["order_value"], ["segment"], APRIL, ["mom_growth_pct"], F.lit(RUN_AT), members=members)
    assert sorted(r.why_id for r in wide.collect()) == sorted(r.why_id for r in narrow.collect())


def test_unexplainable_features_are_reported(tables, spark):
    rows = spark.createDataFrame([("a", "rank"), ("b", "mom_growth_pct")], "signal_id string, feature_name string")
    known, rest = wy.explainable(rows, ["rank", "mom_growth_pct"])
    assert known == ["mom_growth_pct"] and [r.signal_id for r in rest.collect()] == ["a"]


def test_upper_bound_comes_from_the_definition(spark):
    signals = spark.createDataFrame([("a", "band"), ("b", "monthly_growth")], "signal_id string, signal_name string")
    got = {r.signal_id: r.threshold2 for r in wy.with_upper_bound(signals, cf.signal_defs_frame(spark, DEFINITIONS)).collect()}
    assert got == {"a": 2.0, "b": None}


def test_sweep_twice_adds_nothing(spark, tables, tmp_path):
    source, output = str(tmp_path / "signals"), str(tmp_path / "out")
    signals = stored_signals(tables).where("job_id in (1, 3)").drop("detected_at").repartition(3)
    signals.write.parquet(source)

    def sweep():
        explain_new_signals(spark, source, output, lambda batch: explain(batch, tables), signals.schema, files_per_batch=1)
        whys = [r.why_id for r in spark.read.parquet(f"{output}/whys").select("why_id").collect()]
        return sorted(whys), spark.read.parquet(f"{output}/ledger").where("batch >= 0").count()

    first = sweep()
    assert len(first[0]) == len(set(first[0])) == explain(spark.read.parquet(source), tables).count() > 0
    assert first[1] == signals.count()
    assert sweep() == first
    signals.limit(4).write.mode("append").parquet(source)
    assert sweep() == first


def test_run_writes_every_stage(spark, tables, tmp_path):
    def write(name, frame):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    out = run.run(spark, STARS, tables, JOBS, DEFINITIONS, APRIL, F.lit(datetime(1998, 5, 1)), ["priority", "nation"], write)
    counts = {r.stage: r["rows"] for r in out.counts().collect()}
    assert counts["signals"] > 0 and counts["whys"] > 0 and counts["standard"] > 0 and counts["dimensional"] > 0
    ids = out.signals.select("signal_id")
    assert ids.distinct().count() == ids.count()
    assert out.whys.join(ids, "signal_id", "left_anti").count() == 0


def test_default_window_applies_without_a_full_period():
    defs = {d.signal_name: d for d in DEFINITIONS}
    half = Job(1, "order_value", ("segment",), ("band",), period_start=date(1999, 1, 1))
    full = Job(2, "order_value", ("segment",), ("band",), period_start=date(1999, 1, 1), period_end=date(1999, 1, 31))
    windows = [p.window for p in plan_jobs(STARS, [half, full], defs, APRIL)]
    assert windows == [APRIL, Window(date(1999, 1, 1), date(1999, 1, 31))]
