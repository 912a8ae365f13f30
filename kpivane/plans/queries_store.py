"""Result tables: appends, upserts, latest rows, pages and lookups."""

from __future__ import annotations

from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import features as ft
from ..sources import store as st
from ..sources.keyed import KeyedTable, TimeTable
from ..sources.stage import stage_root
from ..sources.tables import Tables
from . import sql as q
from .queries_signals import HISTORY, HISTORY_COLUMNS, WHYS, ledger, signal_history, stored_signals, stored_whys
from .registry import query
from .retail import ORDERS

_H = ", ".join(HISTORY_COLUMNS)


@query("aligned_append", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CAST(CAST(ts AS DATE) AS DATE) AS day FROM events""")
def aligned_append(t: Tables) -> DataFrame:
    """Rows as an append would write them: target columns only, NaN and infinity as NULL."""
    target = StructType.fromDDL("event_id bigint, value double, day date, unknown string")
    key = F.col("event_id")
    raw = t("events").select(
        "event_id", F.when(key % 6 == 0, float("nan")).when(key % 6 == 3, float("-inf")).otherwise(F.col("value")).alias("value"),
        F.col("ts").cast("date").cast("string").alias("day"), F.col("event_type").alias("not_in_target"))
    return st.align(raw, target)[0]


def _folder(t: Tables, name: str) -> str:
    return f"{stage_root(t.spark).rstrip('/')}/{name}-{uuid4().hex}"


def _kpi_results(t: Tables, shift: int) -> DataFrame:
    """KPI values by month and segment; a later computation covers later months and adds a factor."""
    monthly = ft.kpi_series(ORDERS, t, ["order_value"], ["segment"])
    rows = monthly if shift == 0 else monthly.where(F.col("period_start") >= F.lit(date(1998, 1, 1)))
    return rows.select(
        "kpi_name", F.col("dimension").alias("grain"), "dimension_value", (F.col("kpi_value") + shift).alias("kpi_value"),
        "period_start", F.last_day("period_start").alias("period_end"), F.lit("kpi").alias("result_type"),
        F.lit("none").alias("dependency_kpi_name"),
        F.lit(date(2001, 1, 1 + shift)).cast("timestamp").alias("computed_at"))


@query("kpi_upsert", f"""WITH {q.OS}, s AS (SELECT c_mktsegment AS dimension_value, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, {q.order_kpi('order_value')} AS v FROM os GROUP BY 1, 2)
SELECT dimension_value, period_start, CASE WHEN period_start >= DATE '1998-01-01' THEN v + 5 ELSE v END AS kpi_value,
  CASE WHEN period_start >= DATE '1998-01-01' THEN DATE '2001-01-06' ELSE DATE '2001-01-01' END AS computed_on FROM s""")
def kpi_upsert(t: Tables) -> DataFrame:
    """A second computation replaces the values it covers in the stored table and leaves the others."""
    table = KeyedTable(t.spark, _folder(t, "kpi-results"), st.KPI_RESULT_KEY, 16)
    table.create(_kpi_results(t, 0))
    table.change(_kpi_results(t, 5), st.upsert_kpi_results)
    return table.read().select("dimension_value", "period_start", "kpi_value", F.col("computed_at").cast("date").alias("computed_on"))


@query("summary_upsert", """SELECT o_orderpriority AS entity, lower(o_orderstatus) AS group_name, CAST(max(o_orderdate) AS DATE) AS updated_on,
  max_by(CAST(o_orderkey AS BIGINT), (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1, 2""")
def summary_upsert(t: Tables) -> DataFrame:
    """Keyed summaries: the newest row of each trimmed entity and lower-cased group."""
    rows = t("orders").select(
        F.concat(F.lit(" "), "o_orderpriority").alias("entity"), F.concat("o_orderstatus", F.lit(" ")).alias("group_name"),
        F.struct("o_orderdate", "o_orderkey").alias("updated_at"), F.col("o_orderkey").alias("last_order"))
    table = KeyedTable(t.spark, _folder(t, "summaries"), ("entity", "group_name"), 16)
    table.create(st.upsert_summaries(rows.where("last_order % 2 = 0"), rows.limit(0)))
    table.change(st.normal_summaries(rows.where("last_order % 2 = 1")), st.upsert_summaries)
    return table.read().select(
        "entity", "group_name", F.col("updated_at.o_orderdate").cast("date").alias("updated_on"), "last_order")


@query("current_period_state", "SELECT 1 AS id, CAST(max(o_orderdate) AS DATE) - 6 AS period_start, CAST(max(o_orderdate) AS DATE) AS period_end FROM orders")
def current_period_state(t: Tables) -> DataFrame:
    """The reporting window as a one-row table, here the data's last week."""
    last = t("orders").agg(F.max("o_orderdate").cast("date").alias("d")).scalar()
    return st.current_period(t.spark, F.date_sub(last, 6), last, "last week", F.lit(datetime(2001, 8, 2))).select(
        "id", "period_start", "period_end")


@query("signal_page", f"WITH {HISTORY} SELECT {_H} FROM hist ORDER BY detected_at DESC, signal_id LIMIT 100 OFFSET 150")
def signal_page(t: Tables) -> DataFrame:
    """The second page and a half of signals, newest first."""
    return st.page(signal_history(t), "detected_at", "signal_id", limit=100, offset=150).select(*HISTORY_COLUMNS)


@query("signal_page_after", f"WITH {HISTORY} SELECT {_H} FROM hist ORDER BY detected_at DESC, signal_id LIMIT 120 OFFSET 120")
def signal_page_after(t: Tables) -> DataFrame:
    """The second page of signals, continued after the last row of the first."""
    table = TimeTable(t.spark, _folder(t, "signal-pages"), "detected_at", "signal_id")
    table.append(signal_history(t))
    first = table.page_after(120).select("detected_at", "signal_id").collect()
    last = (first[-1]["detected_at"], first[-1]["signal_id"]) if first else None
    return table.page_after(120, last).select(*HISTORY_COLUMNS)


@query("insight_view", """SELECT CAST(o_orderkey AS VARCHAR) AS "InsightID", o_orderpriority AS "DimensionValue", CAST(o_orderdate AS DATE) AS "PeriodStart",
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "Park", o_totalprice AS "Remarks" FROM orders""")
def insight_view(t: Tables) -> DataFrame:
    """Outward names, ids as text, the parked flag as 0 or 1."""
    status = F.col("o_orderstatus")
    rows = t("orders").select(
        F.col("o_orderkey").alias("insight_id"), F.col("o_orderpriority").alias("dimension_value"),
        F.col("o_orderdate").cast("date").alias("period_start"),
        F.when(status == "F", True).when(status == "O", False).alias("park"), F.col("o_totalprice").alias("remarks"))
    return st.insight_view(rows)


@query("latest_per_kpi_dim", f"""WITH {HISTORY}, m AS (SELECT *, max(detected_at) OVER (PARTITION BY kpi_name, dimension) AS top FROM hist)
SELECT {_H} FROM m WHERE detected_at = top""")
def latest_per_kpi_dim(t: Tables) -> DataFrame:
    """Signals of the latest run of each KPI and dimension, ties kept."""
    return st.latest_signals(signal_history(t)).select(*HISTORY_COLUMNS)


@query("latest_per_id", f"WITH {HISTORY} SELECT {_H}, 2 AS version FROM hist WHERE substr(signal_id, 1, 1) < '8'")
def latest_per_id(t: Tables) -> DataFrame:
    """The newer of two versions of each requested signal."""
    signals = signal_history(t)
    newer = signals.withColumns({"detected_at": F.col("detected_at") + F.expr("interval 1 day"), "version": F.lit(2)})
    both = signals.withColumn("version", F.lit(1)).unionByName(newer)
    return st.latest_per_id(both, ledger(signals)).select(*HISTORY_COLUMNS, "version")


@query("signal_ids_by_kpi", f"WITH {HISTORY} SELECT DISTINCT signal_id FROM hist")
def signal_ids_by_kpi(t: Tables) -> DataFrame:
    return st.signal_ids_of(signal_history(t), [" ORDER_VALUE"], unprocessed_only=True)


def _priors(t: Tables) -> DataFrame:
    """A prior per customer: target, p-value (some unknown) and activity follow from its columns."""
    key = F.col("c_custkey")
    return t("customer").select(
        key.alias("prior_id"), F.when(key % 2 == 0, "Order_Value").otherwise("revenue").alias("target_kpi"),
        F.when(key % 7 != 0, F.abs("c_acctbal") / 100000).alias("p_value"), (key % 5 != 0).alias("is_active"))


@query("priors_lookup", """SELECT c_custkey AS prior_id, 'Order_Value' AS target_kpi, CASE WHEN c_custkey % 7 <> 0 THEN abs(c_acctbal) / 100000 END AS p_value FROM customer
WHERE c_custkey % 2 = 0 AND c_custkey % 5 <> 0 AND (c_custkey % 7 = 0 OR abs(c_acctbal) / 100000 <= 0.05)""")
def priors_lookup(t: Tables) -> DataFrame:
    return st.correlation_priors(_priors(t), ["order_value"], 0.05).drop("is_active")


@query("anomaly_lookup", """WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start_date, event_type AS kpi_name, user_id % 3 AS k, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT kpi_name, week_start_date, k, n FROM w WHERE kpi_name IN ('click', 'error') AND k <> 2 AND n % 2 = 0 AND week_start_date >= DATE '2024-01-31' - 21""")
def anomaly_lookup(t: Tables) -> DataFrame:
    """Anomalous weeks of two event types in the three weeks before an explicit day."""
    week = F.date_trunc("week", "ts").cast("date")
    rows = t("events").groupBy(week.alias("week_start_date"), F.col("event_type").alias("kpi_name"), (F.col("user_id") % 3).alias("k")).agg(
        F.count(F.lit(1)).alias("n")).withColumns({
            "is_active": F.col("k") != 2, "anomaly_flag": F.when(F.col("n") % 2 == 0, -1).otherwise(1)})
    return st.anomaly_timeline(rows, ["Click", "error"], F.lit(date(2024, 1, 31)), 3).select("kpi_name", "week_start_date", "k", "n")


@query("signals_of_batch", f"WITH {HISTORY} SELECT {_H} FROM hist WHERE detected_at = (SELECT max(detected_at) FROM hist WHERE detected_at < TIMESTAMP '1998-04-15')")
def signals_of_batch(t: Tables) -> DataFrame:
    """All signals of one detection time and KPI."""
    return st.signals_of_batch(signal_history(t), F.lit("1998-03-31").cast("timestamp"), "Order_Value").select(*HISTORY_COLUMNS)


@query("whys_for_ids", f"WITH {WHYS} SELECT why_id, signal_id, change_pct FROM why WHERE substr(signal_id, 1, 1) < '8'")
def whys_for_ids(t: Tables) -> DataFrame:
    signals = stored_signals(t)
    return st.whys_of(stored_whys(t, signals), ledger(signals)).select("why_id", "signal_id", "change_pct")


@query("signal_with_whys", f"""WITH {WHYS} SELECT sig.signal_id, sig.dimension, sig.dimension_value, why_id, why.dimension_name AS why_dimension,
  why.dimension_value AS why_value, dep_kpi_name, change_pct FROM sig LEFT JOIN why USING (signal_id)""")
def signal_with_whys(t: Tables) -> DataFrame:
    signals = stored_signals(t)
    return st.signal_with_whys(signals, stored_whys(t, signals)).select(
        "signal_id", "dimension", "dimension_value", "why_id", "why_dimension", "why_value", "dep_kpi_name", "change_pct")


@query("latest_batch", f"WITH {HISTORY} SELECT CAST(max(detected_at) AS DATE) AS detected_on FROM hist")
def latest_batch(t: Tables) -> DataFrame:
    return st.latest_batch(signal_history(t)).select(F.col("detected_at").cast("date").alias("detected_on"))


def _insights(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t("orders").select(
        key.alias("insight_id"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("run_timestamp"),
        F.struct("o_orderdate", key).alias("created_at"),
        F.when(key % 3 == 0, "  ").when(key % 3 == 1, "Call the customer.").alias("recommended_actions"))


@query("latest_run", "SELECT CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS run_timestamp FROM orders")
def latest_run(t: Tables) -> DataFrame:
    return st.latest_run(_insights(t))


@query("lacking_actions", "SELECT o_orderkey AS insight_id FROM orders WHERE o_orderkey % 3 <> 1 AND CAST(date_trunc('month', o_orderdate) AS DATE) = DATE '1998-04-01'")
def lacking_actions(t: Tables) -> DataFrame:
    """Insights of one run that still have no action text."""
    return st.lacking_actions(_insights(t), F.lit(date(1998, 4, 1))).select("insight_id")


@query("signal_append", f"WITH {HISTORY} SELECT signal_id, kpi_name, feature_value FROM hist WHERE dimension IN ('segment', 'priority')")
def signal_append(t: Tables) -> DataFrame:
    """Two appends to one table, the second with unusable ids that are left out."""
    target = StructType.fromDDL("signal_id string, kpi_name string, feature_value double")
    signals = signal_history(t)
    path = f"{stage_root(t.spark).rstrip('/')}/append-{uuid4().hex}"
    st.append(signals.where("dimension = 'segment'"), path, target)
    rest = signals.where("dimension in ('priority', 'nation')").withColumn(
        "signal_id", F.when(F.col("dimension") == "nation", "  ").otherwise(F.col("signal_id")))
    st.append(st.usable_whys(rest), path, target)
    return t.spark.read.schema(target).parquet(path)
