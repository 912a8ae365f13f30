"""KPI groups of insights: tagging, filtering, period split and summary blocks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import clipped, signed_percent, stored_number
from ..sources.config import inline_rows

# Characters kept of each text field in a summary block.
CLIPS = {"why": 1200, "insight": 600, "insight_summary": 400}


def group_map(spark: SparkSession, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    rows = [(k.strip().lower(), g) for g, names in groups.items() for k in names]
    return inline_rows(spark, rows, "map_kpi string, group_id string")


def kpi_list(column: str) -> Column:
    """Names in a comma-separated field, trimmed and lower-cased."""
    parts = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda p: F.lower(F.trim(p)))
    return F.filter(parts, lambda p: p != "")


def tag_groups(
    insights: DataFrame, groups: Mapping[str, Sequence[str]], overwrite: bool = True, clear_unmapped: bool = False
) -> DataFrame:
    """Group tag of each insight from the KPIs it names, and whether it changes the stored one."""
    names = F.coalesce(F.when(F.trim("kpi") != "", F.col("kpi")), F.col("kpi_family")) \
        if "kpi_family" in insights.columns else F.col("kpi")
    keyed = insights.withColumn("__names", names)
    # The map is configuration: each row looks its names up in a constant.
    of_kpi: dict[str, list[str]] = {}
    for group, kpis in groups.items():
        for kpi in kpis:
            of_kpi.setdefault(kpi.strip().lower(), []).append(group)
    none = F.array().cast("array<string>")
    known = F.create_map(*[c for k, g in of_kpi.items() for c in (F.lit(k), F.array(*map(F.lit, g)))]) if of_kpi else None
    found = none if known is None else F.flatten(F.transform(kpi_list("__names"), lambda k: F.coalesce(known[k], none)))
    joined = keyed.withColumn("wanted", F.nullif(F.array_join(F.array_sort(F.array_distinct(found)), ","), F.lit("")))
    stored = F.nullif(F.col("group_name"), F.lit(""))
    allowed = F.lit(True) if overwrite else stored.isNull()
    eligible = F.col("wanted").isNotNull() | F.lit(clear_unmapped)
    changes = eligible & allowed & ~stored.eqNullSafe(F.col("wanted"))
    return joined.withColumns({
        "unmapped": F.col("wanted").isNull(), "changed": changes,
        "group_name": F.when(changes, F.col("wanted")).otherwise(F.col("group_name")),
    }).drop("__names", "wanted")


def tag_report(tagged: DataFrame) -> DataFrame:
    return tagged.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("changed").alias("changed"),
        F.count_if("unmapped").alias("unmapped"),
    )


def norm_tag(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"\s+", ""))


def in_group(column: str, group: str) -> Column:
    """True when a comma-separated tag field names the group, ignoring case and spaces."""
    wanted = "".join(group.split()).lower()
    tags = F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), norm_tag)
    return F.array_contains(tags, wanted) if wanted else F.lit(False)


def names_any(column: str, kpis: Sequence[str]) -> Column:
    """True when a comma-separated KPI field names any of the KPIs."""
    return F.arrays_overlap(kpi_list(column), F.array(*[F.lit(k.strip().lower()) for k in kpis]))


def split_periods(insights: DataFrame, monthly: str, weekly: str, fallback: bool = False) -> DataFrame:
    """Bucket by exact trimmed label; with `fallback`, weekly takes whatever is not monthly."""
    label = F.trim(F.coalesce("period", F.lit("")))
    bucket = F.when(label == monthly, "monthly")
    bucket = bucket.otherwise("weekly") if fallback else bucket.when(label == weekly, "weekly")
    return insights.withColumn("bucket", bucket).where("bucket is not null")


def window_from_rows(insights: DataFrame, label: str) -> DataFrame:
    """Earliest start and latest end of the rows with one label."""
    return (
        insights.where(F.trim("period") == label.strip()).groupBy(F.trim("period").alias("period"))
        .agg(F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"))
    )


def window_or_default(found: DataFrame, label: str, start: Column | None, end: Column | None) -> DataFrame:
    """The stored window when it has both dates, else the configured default, else an error."""
    stored = found.where("period_start is not null and period_end is not null").select(
        F.struct("period_start", "period_end", F.lit("stored").alias("source")).alias("w")
    )
    default = F.raise_error(F.lit(f"no window is stored or configured for '{label}'"))
    if start is not None and end is not None:
        default = F.struct(start.alias("period_start"), end.alias("period_end"), F.lit("default").alias("source"))
    chosen = stored.agg(F.first("w").alias("w")).select(F.coalesce("w", default).alias("w"))
    return chosen.select(F.lit(label).alias("period"), "w.period_start", "w.period_end", "w.source")


def insight_blocks(insights: DataFrame) -> DataFrame:
    """Clipped text block of each insight; rows with nothing to say are left out."""
    def text(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    field = {name: clipped(F.col(name), n) for name, n in CLIPS.items()}
    says = (
        (text("title") != "") | (text("kpi") != "") | (field["why"] != "")
        | (field["insight"] != "") | (field["insight_summary"] != "")
    )
    block = F.concat(
        F.lit("Period: "), text("period"), F.lit("\nTitle: "), text("title"), F.lit("\nKPI: "), text("kpi"),
        F.lit("\nSlice: "), text("dimension_name"), F.lit(" — "), text("dimension_value"),
        F.lit("\nWhy: "), field["why"], F.lit("\nWhat: "), field["insight"],
        F.lit("\nSummary: "), field["insight_summary"], F.lit("\n"),
    )
    return insights.where(says).select("insight_id", block.alias("block"))


def signal_blocks(signals: DataFrame) -> DataFrame:
    """Text block of each signal with its signed change."""
    def text(name: str) -> Column:
        return stored_number(F.col(name))

    change = signed_percent(F.col("current_kpi_value"), F.col("prev_kpi_value"))
    block = F.concat(
        F.lit("KPI: "), F.trim("kpi_name"), F.lit("\nSignal: "), F.trim(F.coalesce("signal_name", F.lit(""))),
        F.lit("\nCurrent: "), text("current_kpi_value"), F.lit("\nPrevious: "), text("prev_kpi_value"),
        F.lit("\nChange: "), change, F.lit("\nSeverity: "), F.trim(F.coalesce("severity", F.lit(""))), F.lit("\n"),
    )
    return signals.where(F.trim(F.coalesce("kpi_name", F.lit(""))) != "").select("signal_id", change.alias("change"), block.alias("block"))
