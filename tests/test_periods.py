"""Windows on the driver and as columns."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from kpivane.functions import periods as P

APRIL = P.Window(date(2024, 4, 1), date(2024, 4, 30))
WEEK = P.Window(date(2024, 4, 8), date(2024, 4, 14))


def test_month_shift_clips():
    assert P.shift_months(date(2024, 3, 31), -1) == date(2024, 2, 29)
    assert P.shift_months(date(2024, 2, 29), -12) == date(2023, 2, 28)
    assert P.shift_months(date(2024, 1, 15), -1) == date(2023, 12, 15)


@pytest.mark.parametrize("feature, window, expected", [
    ("wow_growth_pct", APRIL, P.Window(date(2024, 3, 25), date(2024, 3, 31))),
    ("mom_growth_pct", APRIL, P.Window(date(2024, 3, 1), date(2024, 3, 30))),
    ("qoq_growth_pct", APRIL, P.Window(date(2024, 1, 1), date(2024, 1, 30))),
    ("yoy_growth_pct", APRIL, P.Window(date(2023, 4, 1), date(2023, 4, 30))),
    ("acceleration", WEEK, P.Window(date(2024, 4, 1), date(2024, 4, 7))),
    ("acceleration", APRIL, P.Window(date(2024, 3, 1), date(2024, 3, 31))),
    ("kpi_vs_rolling_avg_pct", APRIL, P.Window(date(2024, 1, 1), date(2024, 3, 31))),
    ("rolling_avg_6m", APRIL, P.Window(date(2023, 10, 1), date(2024, 3, 31))),
    ("std_dev_3m", APRIL, P.Window(date(2024, 1, 1), date(2024, 3, 31))),
    ("growth_pct", WEEK, P.Window(date(2024, 4, 1), date(2024, 4, 7))),
    ("growth_abs", APRIL, P.Window(date(2024, 3, 1), date(2024, 3, 30))),
    ("rank", APRIL, P.Window(date(2024, 3, 2), date(2024, 3, 31))),
])
def test_prior_window(feature, window, expected):
    assert P.prior_window(feature, window) == expected


def test_columns_agree_with_the_driver(spark):
    features = ["wow_x", "mom_x", "qoq_x", "yoy_x", "acceleration", "kpi_vs_rolling", "rolling_avg", "rolling_avg_12m",
                "std_dev", "growth_pct", "rank"]
    spans = [(date(2024, 3, 31), n) for n in (0, 13, 14, 30, 91)] + [(date(2024, 2, 29), 6)]
    rows = [(f, s, date.fromordinal(s.toordinal() + n)) for f in features for s, n in spans]
    frame = spark.createDataFrame(rows, "f string, s date, e date")
    a, b = P.prior_window_columns(F.col("f"), F.col("s"), F.col("e"))
    for r in frame.select("f", "s", "e", a.alias("a"), b.alias("b")).collect():
        assert (r.a, r.b) == (lambda w: (w.start, w.end))(P.prior_window(r.f, P.Window(r.s, r.e))), r


def test_grains_and_tiles():
    assert [P.acceleration_grain(n)[:3] for n in (7, 14, 15, 95, 96, 100, 101)] == ["wow", "wow", "mom", "mom", "qoq", "qoq", "yoy"]
    assert P.acceleration_grain(91, "qoq_growth_pct") == "qoq_growth_pct"
    assert P.tile_prior(WEEK, "week") == P.Window(date(2024, 4, 1), date(2024, 4, 7))
    assert P.tile_prior(APRIL, "month") == P.Window(date(2024, 3, 1), date(2024, 3, 30))
    assert P.week_of(date(2024, 4, 10)) == WEEK


def test_labels(spark):
    rows = [(date(2026, 3, 15), date(2026, 3, 21)), (date(2026, 2, 15), date(2026, 3, 3)), (date(2025, 12, 29), date(2026, 1, 4))]
    frame = spark.createDataFrame(rows, "s date, e date").select(P.period_label(F.col("s"), F.col("e")).alias("x"))
    assert [r.x for r in frame.collect()] == ["15-21 Mar", "15 Feb–3 Mar 2026", "2025-12-29–2026-01-04"]


def test_window_from_text(spark):
    texts = ["DATESBETWEEN calendar ( date(2026, 3, 1) , DATE(2026,3,7) ) x CALENDAR(DATE(1,1,1),DATE(1,1,1))",
             "CALENDAR(DATE(2026,3,7),DATE(2026,3,1))", "CALENDAR(DATE(2026,13,7),DATE(2026,3,1))", "nothing", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    a, b = P.window_from_text(F.col("t"))
    got = [tuple(r) for r in frame.select(a, b).collect()]
    week = (date(2026, 3, 1), date(2026, 3, 7))
    assert got == [week, week, (None, None), (None, None), (None, None)]


def test_overlapping_windows_merge(spark):
    days = spark.range(40).select(F.date_add(F.lit(date(2024, 3, 20)), F.col("id").cast("int")).alias("d"))
    joined = P.any_window(F.col("d"), [APRIL, P.Window(date(2024, 3, 25), date(2024, 4, 2))])
    listed = [date.fromordinal(date(2024, 3, 20).toordinal() + i) for i in range(40)]
    assert days.where(joined).count() == sum(date(2024, 3, 25) <= d <= date(2024, 4, 30) for d in listed)
