"""Result tables, clusters and groups."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kpivane.operators import clusters as cl
from kpivane.operators import groups as gr
from kpivane.operators import tiles as ti
from kpivane.sources import store as st
from kpivane.sources.stage import settled, stage_root
from kpivane.sources.tables import typed_read


def test_aligned_append(spark, tmp_path):
    target = StructType.fromDDL("id bigint, value double")
    frame = spark.createDataFrame([(1, float("nan"), "x"), (2, float("inf"), "y"), (3, 1.5, "z")], "id int, value double, extra string")
    path = str(tmp_path / "t")
    assert st.append(frame, path, target) == ["extra"]
    assert st.append(frame, path, target) == ["extra"]
    assert sorted((r.id, r.value) for r in spark.read.parquet(path).collect() if r.value) == [(3, 1.5), (3, 1.5)]
    with pytest.raises(st.SchemaMismatch):
        st.append(frame.select("extra"), path, target)


def test_typed_read(spark):
    raw = spark.createDataFrame([("1.5", "true", "2024-02-30"), ("NaN", "TRUE", "2024-02-29"), ("x", None, None)], "a string, B string, c string")
    got = [tuple(r) for r in typed_read(raw, {"a": "double", "b": "boolean", "c": "date", "d": "int"}).collect()]
    assert got == [(1.5, True, None), (None, None, date(2024, 2, 29)), (None, None, None)]


def test_upsert_keeps_the_dependency_apart(spark):
    ddl = ("kpi_name string, grain string, dimension_value string, period_start date, period_end date, result_type string, "
           "dependency_kpi_name string, kpi_value double, computed_at timestamp")
    base = ("k", "g", "m", date(2024, 1, 1), date(2024, 1, 31), "kpi")
    stored = spark.createDataFrame([(*base, None, 1.0, datetime(2024, 2, 1)), (*base, "dep", 5.0, datetime(2024, 2, 1))], ddl)
    fresh = spark.createDataFrame([(*base, None, 2.0, datetime(2024, 2, 2))], ddl)
    assert sorted(r.kpi_value for r in st.upsert_kpi_results(stored, fresh).collect()) == [2.0, 5.0]


def test_page_limits(spark):
    frame = spark.range(30).select(F.col("id").alias("signal_id"), (F.col("id") % 3).alias("detected_at"))
    assert st.page(frame, "detected_at", "signal_id", limit=0).count() == 1
    assert [r.signal_id for r in st.page(frame, "detected_at", "signal_id", limit=3, offset=9).collect()] == [29, 1, 4]


def test_stage_uses_the_named_folder(spark):
    assert stage_root(spark) == stage_root(spark)
    frame = spark.range(5).withColumn("d", F.lit(date(2024, 1, 1)))
    assert sorted(settled(frame).collect()) == frame.collect()


def whys(spark, rows):
    return spark.createDataFrame(rows, "why_id string, signal_id string, kpi_name string, dimension_name string, dimension_value string, "
                                 "signal_name string, dep_kpi_name string, dep_kpi_label string, rationale string, current_value double, "
                                 "prev_value double, change_pct double, period string, period_start date, period_end date")


def why(i, signal="s1", dep=None, label=None, start=date(2024, 4, 1)):
    return (f"w{i}" if i is not None else None, signal, "close_rate", "region", "West", "drop", dep, label, "r|1\n2", 0.21, 0.3, -30.0, "p", start, date(2024, 4, 30))


def test_dedupe_and_lines(spark):
    frame = whys(spark, [why(1), why(1), why(None), why(None), why(2, dep="leads", label="Leads")])
    assert cl.dedupe_whys(frame).count() == 3
    lines = [r.line for r in cl.why_payload(cl.driver_first(frame.dropDuplicates())).collect()]
    assert "w2 | s1 | Leads | region | West | leads | 0.21 | 0.3 | -30.0 | r/1 2" in lines
    assert "n/a | s1 | n/a | region | West | null | 21% | 30% | -30.0 | r/1 2" in lines


def test_size_gate_and_long_clusters(spark):
    signals = spark.createDataFrame(
        [(f"s{i:05d}", "k", "hot" if i % 3 else "cold", f"m{i:05d}") for i in range(3000)],
        "signal_id string, kpi_name string, dimension string, dimension_value string")
    frame = whys(spark, [why(i, f"s{i:05d}") for i in range(3000)])
    got = {r.dimension_name: r for r in cl.standard_clusters(signals, frame, 10_000, ids=True).collect()}
    assert got["hot"].signal_count == 2000 and got["hot"].why_count == 2000 and not got["hot"].kept
    assert got["hot"].signal_ids.count(",") == 1999 and len(got["hot"].dimension_value) == 4000
    assert got["cold"].signal_ids.count(",") == 999
    assert got["hot"].dimension_value.startswith("m00001, m00002, m00004")


def test_text_limit_floor():
    assert cl.text_limit() == 200_000 and cl.text_limit(5) == 1024 and cl.text_limit(5000) == 5000


def test_many_windows_and_slices(spark):
    frame = whys(spark, [why(i, start=date(2024, 1, 1 + i)) for i in range(5)])
    row = cl.windows_of(frame, ["signal_id"]).first()
    assert row.window_count == 5 and row.windows.startswith("mixed: 2024-01-01 to 2024-04-30; ") and row.windows.endswith("; +2 more")
    signals = spark.createDataFrame([("k", "d", f"m{i:02d}") for i in range(20)], "kpi_name string, dimension string, dimension_value string")
    text = cl.slice_summary(signals, ["kpi_name"]).first().slice_summary
    assert text.endswith("d — m15 (+4 more slices)") and text.count(",") == 15


def test_canonical_member(spark):
    rows = [("NA", ["x"]), ("west", ["x", "y"]), ("", ["y", "x"]), ("n/a", [])]
    frame = spark.createDataFrame(rows, "b string, v array<string>")
    assert [r.x for r in frame.select(cl.canonical_member(F.col("b"), F.col("v")).alias("x")).collect()] == ["x", "west", "x, y", "n/a"]


def test_group_tags_options(spark):
    groups = {"g1": ["a", "B"], "g2": ["b"]}
    rows = [(1, "A , b", None), (2, "z", "old"), (3, "a", "g1"), (4, "b", "old")]
    frame = spark.createDataFrame(rows, "insight_id int, kpi string, group_name string")

    def tagged(**options):
        out = gr.tag_groups(frame, groups, **options)
        return {r.insight_id: (r.group_name, r.changed) for r in out.collect()}

    assert tagged() == {1: ("g1,g2", True), 2: ("old", False), 3: ("g1", False), 4: ("g1,g2", True)}
    assert tagged(overwrite=False)[4] == ("old", False)
    assert tagged(clear_unmapped=True)[2] == (None, True)


def test_slices_and_parents():
    assert ti.slice_members(" a, b ,,a") == ("a", "b") and ti.slice_members(["a,b", "c"]) == ("a", "b", "c")
    assert ti.parent_key("KPI Portfolio") == "kpi_portfolio" and ti.parent_key(" Lead-Source ") == "lead_source"


def test_breakdown_needs_a_member(tables):
    from kpivane.plans.retail import APRIL, ORDERS

    with pytest.raises(ValueError):
        ti.insight_breakdown(ORDERS, tables, ["order_value"], ["segment", "region"], APRIL, "segment", " ")


def test_correlation_priors_order(spark):
    frame = spark.createDataFrame([("K", 0.2, True), ("k", None, True), ("k", 0.05, True), ("k", 0.01, False), ("x", 0.01, True)],
                                  "target_kpi string, p_value double, is_active boolean")
    assert [r.p_value for r in st.correlation_priors(frame, [" k"]).collect()] == [0.05, None]


def test_window_falls_back_or_fails(spark):
    rows = [("a", date(2024, 4, 1), None), ("b", date(2024, 4, 1), date(2024, 4, 7)), (" b ", date(2024, 3, 30), date(2024, 4, 2))]
    frame = spark.createDataFrame(rows, "period string, period_start date, period_end date")
    start, end = F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 7))

    def window(label, a=start, b=end):
        return tuple(gr.window_or_default(gr.window_from_rows(frame, label), label, a, b).first())

    assert window("b") == ("b", date(2024, 3, 30), date(2024, 4, 7), "stored")
    assert window("a") == ("a", date(2024, 1, 1), date(2024, 1, 7), "default")
    with pytest.raises(Exception, match="no window"):
        window("a", None, None)
