"""Feature edge cases on hand-made frames."""

import random
from datetime import date

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpivane.functions.numbers import finite, snapshot_change
from kpivane.operators import features as ft


def series(spark, values, months=None, member="a"):
    months = months or [date(2024, i + 1, 1) for i in range(len(values))]
    rows = [("k", "d", member, m, v) for m, v in zip(months, values)]
    return spark.createDataFrame(rows, "kpi_name string, dimension string, dimension_value string, period_start date, kpi_value double")


def run(frame, function, **params):
    out = ft.add_series_features(frame, {"f": (function, params)})
    return [r.f for r in out.orderBy("dimension_value", "period_start").collect()]


def test_first_period_and_zero_prior(spark):
    assert run(series(spark, [10.0]), ft.growth_pct) == [None]
    assert run(series(spark, [0.0, 5.0]), ft.growth_pct) == [None, None]
    assert run(series(spark, [0.0, 5.0]), ft.growth_abs) == [None, 5.0]


def test_negative_prior_is_signed_in_series_and_absolute_in_snapshots(spark):
    assert run(series(spark, [-4.0, 2.0]), ft.growth_pct) == [None, -150.0]
    one = spark.range(1).select(snapshot_change(F.lit(2.0), F.lit(-4.0)).alias("x")).first().x
    assert one == 150.0


def test_gap_month(spark):
    gap = series(spark, [10.0, 12.0], [date(2024, 1, 1), date(2024, 3, 1)])
    assert run(gap, ft.growth_pct) == [None, 20.0]
    assert run(gap, ft.strict_growth) == [None, None]
    assert run(gap, ft.strict_growth, periods=2) == [None, 20.0]


def test_missing_value(spark):
    frame = series(spark, [1.0, None, 2.0])
    assert run(frame, ft.cumulative_sum) == [1.0, None, 3.0]
    assert run(frame, ft.growth_pct) == [None, None, None]


def test_points(spark):
    assert run(series(spark, [0.20, 0.25]), ft.growth_pct, points=True) == [None, 5.0]
    assert run(series(spark, [20.0, 25.0]), ft.growth_abs, points=True) == [None, 5.0]


def test_rolling_window_spans_calendar_months(spark):
    frame = series(spark, [1.0, 2.0, 6.0], [date(2024, 1, 1), date(2024, 2, 1), date(2024, 6, 1)])
    assert run(frame, ft.rolling_avg, months=3) == [1.0, 1.5, 6.0]
    assert run(frame, ft.rolling_rows_avg, window=3) == [1.0, 1.5, 3.0]
    assert run(frame, ft.rolling_avg, days=3) == [1.0, 1.5, 6.0]


def test_std_needs_two_values(spark):
    assert run(series(spark, [7.0, 7.0, 7.0]), ft.std_dev) == [None, 0.0, 0.0]
    assert run(series(spark, [7.0, 7.0, 7.0]), ft.rolling_z_score) == [None, None, None]


def test_acceleration(spark):
    assert run(series(spark, [100.0, 110.0, 132.0]), ft.acceleration) == [None, None, 10.0]
    assert run(series(spark, [1.0, 3.0, 9.0]), ft.acceleration_abs) == [None, None, 4.0]
    assert run(series(spark, [0.1, 0.2, 0.4]), ft.acceleration, points=True) == [None, None, 10.0]


def test_members_do_not_mix(spark):
    both = series(spark, [1.0, 2.0]).unionByName(series(spark, [10.0, 5.0], member="b"))
    assert run(both, ft.growth_pct) == [None, 100.0, None, -50.0]


def cross(spark, values):
    rows = [("k", "d", f"m{i}", date(2024, 1, 1), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "kpi_name string, dimension string, dimension_value string, period_start date, kpi_value double")


@pytest.mark.parametrize("bounded", [True, False])
def test_rank_ties_single_member_and_missing(spark, bounded):
    def ranks(values, **kw):
        out = ft.add_rank(cross(spark, values), bounded=bounded, **kw).orderBy("dimension_value").collect()
        return [r["rank"] for r in out], [r["rank_pct"] for r in out]

    assert ranks([5.0, 9.0, 9.0, 1.0]) == ([3.0, 1.0, 1.0, 4.0], [75.0, 25.0, 25.0, 100.0])
    assert ranks([5.0]) == ([None], [None])
    assert ranks([5.0, None, 4.0], ascending=True) == ([2.0, None, 1.0], [100.0, None, 50.0])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e9, 1e9), st.sampled_from([0.0, 1.0, 1.0000001, -1.0])), min_size=1, max_size=60))
def test_ranged_rank_equals_brute_force(spark, values):
    got = ft.add_rank(cross(spark, values)).collect()
    known = [v for v in values if v is not None]
    for row in got:
        v = row.kpi_value
        expected = None if v is None or len(known) < 2 else float(1 + sum(x > v for x in known))
        assert row["rank"] == expected


def test_hot_group_rank(spark):
    random.seed(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(random.randint(0, 40)) / 7) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, kpi_value double")
    got = ft.add_rank(frame, within=["g"]).toPandas()
    want = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"].rank(ascending=False, method="min")
    assert sorted(got["rank"]) == sorted(want)


@pytest.mark.parametrize("ascending", [True, False])
def test_ranges_follow_the_values(spark, monkeypatch, ascending):
    """Close values beside an outlier, a group of few values, ties and nulls; no range takes more than its share."""
    monkeypatch.setattr(ft, "RANGE_VALUES", 500)
    rng = random.Random(8)
    rows = [("close", 5.0 + i * 1e-9) for i in range(20_000)] + [("close", 1e12), ("close", None)]
    rows += [("few", float(rng.randint(0, 9))) for _ in range(3_000)] + [("log", 10.0 ** rng.uniform(-300, 300)) for _ in range(4_000)]
    rows += [(None, float(i % 700)) for i in range(2_000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, kpi_value double")
    counts = frame.where("kpi_value is not null").groupBy("g", "kpi_value").count()
    sizes = ft.value_ranges(counts, ["g"], "kpi_value").groupBy("g", "__range").agg(F.count("*").alias("n")).toPandas()
    for name, whole in (("close", 20_001), ("log", 4_000)):
        mine = sizes[sizes.g == name]
        assert mine.n.sum() == whole and mine.n.max() <= 0.05 * whole
    assert len(sizes[sizes.g == "few"]) == 1
    got = ft.add_rank(frame, within=["g"], ascending=ascending).toPandas()
    want = got.groupby("g", dropna=False)["kpi_value"].rank(ascending=ascending, method="min")
    assert ((got["rank"] == want) | (got["rank"].isna() & want.isna())).all()


def test_rank_reads_its_input_without_writing_it(spark):
    frame = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("kpi_value"))
    assert "Scan parquet" not in ft.add_rank(frame, within=["g"])._jdf.queryExecution().toString()


def test_constant_and_zero_total(spark):
    flat = ft.add_period_stats(cross(spark, [7.0, 7.0, 7.0])).collect()
    assert all(r.z_score is None for r in flat)
    zero = ft.add_period_stats(cross(spark, [3.0, -3.0])).collect()
    assert all(r.mix is None for r in zero)


def test_benchmark(spark):
    one = spark.range(1)
    values = one.select(
        ft.benchmark_variance(F.lit(12.0), 10.0).alias("a"), ft.benchmark_variance(F.lit(12.0), 0.0).alias("b"),
        ft.benchmark_variance(F.lit(12.0), None).alias("c"), ft.benchmark_variance(F.lit(12.0), 10.0, False).alias("d"),
        finite(F.lit(float("nan"))).alias("e"), finite(F.lit(float("inf"))).alias("f"),
    ).first()
    assert tuple(values) == (20.0, None, None, 2.0, None, None)


def test_strict_acceleration_and_registry(spark):
    frame = series(spark, [100.0, 110.0, 132.0])
    got = ft.add_strict_acceleration(frame).orderBy("period_start").collect()
    assert [r.acceleration for r in got] == [None, None, 10.0]
    ft.register_feature("calculate_doubled", lambda v, s, by: v * by, by=2)
    assert [r.doubled for r in ft.add_series_features(frame, ["doubled"]).orderBy("period_start").collect()] == [200.0, 220.0, 264.0]
    assert ft.feature_def("calculate_rank").kind == "cross" and ft.feature_def("no_such").kind == "cross"
