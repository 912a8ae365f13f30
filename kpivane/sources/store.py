"""Result tables: aligned appends, keyed upserts and the reads that feed later steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from ..functions.numbers import finite

KPI_RESULT_KEY = ("kpi_name", "grain", "dimension_value", "period_start", "period_end", "result_type", "dependency_kpi_name")
PAGE_LIMIT = 5000


class SchemaMismatch(ValueError):
    """No column of the frame exists in the target."""


def align(frame: DataFrame, target: StructType) -> tuple[DataFrame, list[str]]:
    """Keep the columns the target has; return the names of the dropped ones too."""
    names = set(target.fieldNames())
    common = [c for c in frame.columns if c in names]
    if not common:
        raise SchemaMismatch(f"none of {frame.columns} exists in the target")
    kept = frame.select(*[
        (finite(F.col(c)) if isinstance(frame.schema[c].dataType, (DoubleType, FloatType)) else F.col(c))
        .cast(target[c].dataType).alias(c)
        for c in common
    ])
    return kept, [c for c in frame.columns if c not in names]


def append(frame: DataFrame, path: str, target: StructType | None = None) -> list[str]:
    """Append to a Parquet table, aligned to its schema. Returns the dropped column names."""
    dropped: list[str] = []
    if target is not None:
        frame, dropped = align(frame, target)
    frame.write.mode("append").parquet(path)
    return dropped


def newest(frame: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key. The row-number limit also runs before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("__place", place).where("__place = 1").drop("__place")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Stored and incoming rows with one row per key, the first by `order`; on a tie the incoming row."""
    both = stored.withColumn("__stored", F.lit(1)).unionByName(incoming.withColumn("__stored", F.lit(0)), allowMissingColumns=True)
    return newest(both, keys, *order, F.col("__stored")).drop("__stored")


def upsert_kpi_results(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """KPI values by natural key, the latest computation wins; the dependency is part of the key."""
    return upsert(stored, incoming, KPI_RESULT_KEY, F.desc("computed_at"))


def normal_summaries(frame: DataFrame, keys: Sequence[str] = ("entity", "group_name")) -> DataFrame:
    """Trimmed keys, the group in lower case; rows with a blank key are refused."""
    out = frame.withColumns({k: F.lower(F.trim(k)) if k == "group_name" else F.trim(k) for k in keys})
    for k in keys:
        out = out.where(F.col(k) != "")
    return out


def upsert_summaries(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("entity", "group_name")) -> DataFrame:
    """Keyed summaries under normal keys, the newest row of each."""
    return upsert(normal_summaries(stored, keys), normal_summaries(incoming, keys), keys, F.desc("updated_at"))


def current_period(spark: SparkSession, start: Column, end: Column, label: str | None, updated_at: Column) -> DataFrame:
    """The one-row table of the reporting window."""
    return spark.range(1).select(
        F.lit(1).alias("id"), start.alias("period_start"), end.alias("period_end"),
        F.lit(label).cast("string").alias("period_label"), updated_at.alias("updated_at"),
    )


def page(frame: DataFrame, time: str, tie: str, limit: int = 500, offset: int = 0,
         run: Column | None = None, family: str | None = None) -> DataFrame:
    """Newest first; the limit is held between 1 and 5000 and the order is total."""
    if run is not None:
        frame = frame.where(F.col("run_timestamp") == run)
    if family:
        frame = frame.where(F.col("kpi_family") == family)
    ordered = frame.orderBy(F.desc(time), tie)
    return ordered.offset(max(0, offset)).limit(max(1, min(limit, PAGE_LIMIT)))


# Stored names and the names of the outward view.
VIEW_NAMES = {
    "insight_id": "InsightID", "run_timestamp": "RunTimestamp", "signal_ids": "SignalIDs",
    "kpi_family": "KPIFamily", "title": "Title", "kpi": "KPI", "dimension_name": "DimensionName",
    "dimension_value": "DimensionValue", "insight": "Insight", "why": "Why", "period": "Period",
    "period_start": "PeriodStart", "period_end": "PeriodEnd", "insight_summary": "InsightSummary",
    "why_insight_summary": "WhyInsightSummary", "severity": "Severity", "tags": "Tags",
    "impact_insight": "ImpactInsight", "park": "Park", "created_at": "CreatedAt", "hook": "Hook",
    "like": "Like", "dislike": "Dislike", "remarks": "Remarks", "recommended_actions": "RecommendedActions",
}


def insight_view(insights: DataFrame) -> DataFrame:
    """Outward column names, ids as text, `park` as 0 or 1."""
    def shown(name: str) -> Column:
        if name == "park":
            return F.when(F.col("park"), 1).otherwise(0)
        return F.col(name).cast("string") if name == "insight_id" else F.col(name)

    return insights.select(*[shown(c).alias(v) for c, v in VIEW_NAMES.items() if c in insights.columns])


def latest_by(frame: DataFrame, keys: Sequence[str], time: str = "detected_at") -> DataFrame:
    """Rows at the latest time of their key, ties kept.

    The maximum is a grouped aggregate joined back, so a key with very many rows stays spread.
    """
    last = frame.groupBy(*keys).agg(F.max(time).alias(time))
    return frame.join(last, [*keys, time], "left_semi")


def latest_signals(signals: DataFrame) -> DataFrame:
    return latest_by(signals, ["kpi_name", "dimension"])


def latest_per_id(signals: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The latest row of each signal id; of rows of one time the first by all columns, so reruns agree."""
    if ids is not None:
        signals = signals.join(ids.select("signal_id").distinct(), "signal_id", "left_semi")
    rest = [F.col(c) for c, kind in signals.dtypes if c not in ("signal_id", "detected_at") and "map<" not in kind]
    return newest(signals, ["signal_id"], F.desc("detected_at"), *rest)


def signal_ids_of(signals: DataFrame, kpis: Sequence[str], unprocessed_only: bool = False) -> DataFrame:
    """Distinct ids of some KPIs, ignoring case."""
    chosen = signals.where(F.lower(F.trim("kpi_name")).isin([k.strip().lower() for k in kpis]))
    if unprocessed_only:
        chosen = chosen.where("not why_computed")
    return chosen.select("signal_id").distinct()


def correlation_priors(priors: DataFrame, kpis: Sequence[str], max_p_value: float = 0.10, active_only: bool = True) -> DataFrame:
    """Usable priors of some KPIs: unknown p-values count and come last."""
    out = priors.where(F.lower("target_kpi").isin([k.strip().lower() for k in kpis]))
    if active_only:
        out = out.where("is_active")
    out = out.where(F.col("p_value").isNull() | (F.col("p_value") <= max_p_value))
    return out.orderBy("target_kpi", F.asc_nulls_last("p_value"))


def anomaly_timeline(timeline: DataFrame, kpis: Sequence[str], as_of: Column, weeks_back: int = 16,
                     active_only: bool = True, anomaly_only: bool = True) -> DataFrame:
    """Recent weeks of some KPIs, by default only the anomalous ones."""
    out = timeline.where(F.lower("kpi_name").isin([k.strip().lower() for k in kpis]))
    if active_only:
        out = out.where("is_active")
    out = out.where(F.col("week_start_date") >= F.date_sub(as_of, 7 * max(1, weeks_back)))
    if anomaly_only:
        out = out.where("anomaly_flag = -1")
    return out.orderBy("kpi_name", "week_start_date")


def signals_of_batch(signals: DataFrame, batch: Column | None = None, kpi: str | None = None) -> DataFrame:
    """All signals, those of one detection time, or those of one KPI in it (ignoring case)."""
    if batch is not None:
        signals = signals.where(F.col("detected_at") == batch)
    if kpi:
        signals = signals.where(F.lower(F.trim("kpi_name")) == kpi.strip().lower())
    return signals


def whys_of(whys: DataFrame, ids: DataFrame) -> DataFrame:
    return whys.join(ids.select("signal_id").distinct(), "signal_id", "left_semi")


def signal_with_whys(signals: DataFrame, whys: DataFrame, signal_id: str | None = None) -> DataFrame:
    """Each signal beside each of its WHY rows; a signal without any keeps one row, an absent one none."""
    if signal_id is not None:
        signals = signals.where(F.col("signal_id") == signal_id)
        whys = whys.where(F.col("signal_id") == signal_id)
    children = whys.select(
        "signal_id", "why_id", F.col("dimension_name").alias("why_dimension"),
        F.col("dimension_value").alias("why_value"), "dep_kpi_name", "change_pct",
    )
    return signals.join(children, "signal_id", "left")


def latest_batch(signals: DataFrame) -> DataFrame:
    return signals.agg(F.max("detected_at").alias("detected_at"))


def latest_run(insights: DataFrame) -> DataFrame:
    """Run of the most recently created insight."""
    return insights.agg(F.max_by("run_timestamp", "created_at").alias("run_timestamp"))


def lacking_actions(insights: DataFrame, run: Column | None = None) -> DataFrame:
    """Insights whose action text is still blank."""
    if run is not None:
        insights = insights.where(F.col("run_timestamp") == run)
    return insights.where(F.trim(F.coalesce("recommended_actions", F.lit(""))) == "")


def usable_whys(whys: DataFrame) -> DataFrame:
    """WHY rows whose signal id looks usable."""
    return whys.where(F.trim(F.coalesce("signal_id", F.lit(""))) != "")
