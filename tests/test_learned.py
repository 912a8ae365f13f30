"""Priors and anomalies fitted to histories with a planted shape."""

import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kpivane.operators import learned as ln
from kpivane.operators.cube import cube_sets, day_cube
from kpivane.operators.model import Dimension, Kpi, Rows, Star, Total

STAR = Star("s", "facts", "d", dimensions=(Dimension("c", "c"), Dimension("part", "part")),
            kpis=(Kpi("cause", Total("x", 4)), Kpi("effect", Total("y", 4)), Kpi("noise", Total("z", 4)), Kpi("n", Rows())))
FACTS = "d date, c string, part string, x double, y double, z double"
FIRST = date(2023, 1, 2)
AT = datetime(2024, 1, 1)


@pytest.mark.parametrize(("t", "freedom", "p"), [
    # Quantiles from printed tables of Student's distribution.
    (12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.228, 10, 0.05), (2.131, 15, 0.05), (2.750, 30, 0.01),
    (1.671, 60, 0.10), (2.617, 120, 0.01), (-2.228, 10, 0.05), (0.0, 7, 1.0), (0.0, 8, 1.0)])
def test_p_values_of_the_tables(spark, t, freedom, p):
    got = spark.range(1).select(ln.two_sided_p(F.lit(t), F.lit(freedom).cast("bigint"))).first()[0]
    assert math.isclose(got, p, abs_tol=2e-4)


def history(spark, weeks=60, spike=None):
    rng = random.Random(6)
    cause = [rng.uniform(50, 150) for _ in range(weeks)]
    rows = []
    for i in range(weeks):
        day = FIRST + timedelta(days=7 * i)
        effect = 3 * cause[i - 2] + rng.uniform(-1, 1) if i >= 2 else 0.0
        for part in ("p", "q"):
            lift = 900.0 if spike == (i, part) else 0.0
            rows.append((day, "m", part, cause[i] / 2, effect / 2, rng.uniform(10, 12) + lift))
            rows.append((day, "k", part, 5.0, 5.0, 5.0))
    frame = spark.createDataFrame(rows, FACTS)
    return lambda _name: frame


def test_a_planted_lag_is_found(spark):
    kpis = ["cause", "effect", "noise"]
    cube = day_cube(STAR, history(spark), kpis, cube_sets(["SELF"]))
    rows = {(r.target_kpi, r.regressor): r for r in ln.fit_priors(cube, STAR, kpis, ["SELF"], "a", F.lit(AT)).collect()}
    assert len(rows) == 6
    best = rows["effect", "cause"]
    assert best.lag == 2 and math.isclose(best.coef, 3, rel_tol=0.02) and best.p_value == 0 and best.is_active
    assert best.business_interpretation == "effect rises with cause 2 weeks later" and best.n == 58
    assert rows["effect", "noise"].p_value > 0.01
    flat = day_cube(STAR, history(spark), kpis, cube_sets(["c"]))
    assert ln.fit_priors(flat.where("c = 'k'"), STAR, kpis, ["c"], "a", F.lit(AT)).count() == 0


def test_versions_replace_and_retire(spark):
    schema = "target_kpi string, regressor string, model_version string, p_value double, is_active boolean"
    stored = spark.createDataFrame([("a", "b", "v1", 0.1, True), ("a", "b", "v2", 0.2, True), ("a", "c", "v2", 0.3, True)], schema)
    fresh = spark.createDataFrame([("a", "b", "v2", 0.9, True)], schema)
    got = sorted(tuple(r) for r in ln.replace_version(stored, fresh, ["target_kpi", "regressor", "model_version"]).collect())
    assert got == [("a", "b", "v1", 0.1, False), ("a", "b", "v2", 0.9, True), ("a", "c", "v2", 0.3, True)]


def test_planted_spikes_are_found_with_their_driver(spark):
    tables = history(spark, spike=(40, "q"))
    rows = ln.fit_anomalies(STAR, tables, ["noise", "n"], ["c", "SELF"], "part", "a", F.lit(AT)).collect()
    flagged = {(r.kpi_name, r.dimension_name, r.dimension_value, r.week_start_date) for r in rows if r.anomaly_flag == -1}
    week = FIRST + timedelta(days=280)
    assert {("noise", "c", "m", week), ("noise", "SELF", "ALL", week)} <= flagged and len(flagged) <= 6
    hit = next(r for r in rows if (r.dimension_name, r.week_start_date, r.kpi_name) == ("SELF", week, "noise"))
    assert hit.top_driver == "part=q" and hit.anomaly_score > 100 and hit.is_active
    # Weeks without enough history are left out, and a member that never moves is never anomalous.
    assert min(r.week_start_date for r in rows) == FIRST + timedelta(days=7 * ln.LEAST_WEEKS)
    assert not [f for f in flagged if f[2] == "k"] and len({r.anomaly_id for r in rows}) == len(rows)
    none = spark.createDataFrame([], FACTS)
    assert ln.fit_anomalies(STAR, lambda _n: none, ["noise"], ["c", "SELF"], "part", "a", F.lit(AT)).count() == 0


def test_a_gap_is_no_history(spark):
    rows = [("m", FIRST + timedelta(days=7 * i), float(i % 3)) for i in range(20)] + [("m", FIRST + timedelta(days=7 * 80), 50.0)]
    series = spark.createDataFrame(rows, "dimension_value string, period_start date, kpi_value double")
    got = {r.period_start: r for r in ln.against_history(series, ["dimension_value"]).collect()}
    assert got[FIRST + timedelta(days=7 * 80)].baseline is None and got[FIRST + timedelta(days=7 * 9)].baseline == 1.0
