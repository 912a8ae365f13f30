"""Signals: feature values against threshold definitions, for all jobs in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.numbers import breaches, pct_change_abs
from ..functions.periods import Window, window_text
from ..sources.config import SIGNAL_ALIASES, Job, SignalDef, inline_rows, signal_defs_frame
from ..sources.stage import settled
from .features import (
    FEATURES, add_period_stats, add_rank, add_series_features, benchmark_variance, feature_def,
    feature_key, kpi_series, pass_through,
)
from .model import SELF, CatalogueError, Star, Value, is_self
from .query import grouped_long, job_filters
from .snapshot import Comparison, filtered_star

FEATURE_COLUMNS = (
    "kpi_name", "dimension", "dimension_value", "feature_name", "kpi_value", "prior_value", "feature_value",
)
MIX_NAMES = ("sku_mix", "channel_mix", "region_mix")


def stable_id(*parts: Column) -> Column:
    """Same natural key, same id: reruns and retried tasks produce equal rows."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def detect(features: DataFrame, defs: DataFrame) -> DataFrame:
    """Every feature value against every definition of that feature.

    An equi-join on the feature name with the operator test on top; the definitions are small
    inline rows, so this is a broadcast join and the value table is not shuffled.
    """
    named = defs.withColumn("feature_name", F.regexp_replace("feature_name", "^calculate_", ""))
    value = F.col("feature_value")
    hit = breaches(F.col("operator"), value, F.col("threshold"), F.col("threshold2"))
    return features.where(value.isNotNull()).join(named, "feature_name").where(hit)


def signal_rows(hits: DataFrame, start: Column, end: Column, detected_at: Column) -> DataFrame:
    """Signal records, rounded to two decimals, with a stable id."""
    def two(column: str) -> Column:
        return F.round(F.col(column), 2)

    return hits.select(
        stable_id(*[F.col(c) for c in ("job_id", "kpi_name", "dimension", "dimension_value", "signal_name",
                                       "feature_name")], start, end).alias("signal_id"),
        "kpi_name", "dimension", "dimension_value", "signal_name", "feature_name",
        two("feature_value").alias("feature_value"),
        two("kpi_value").alias("current_kpi_value"),
        two("prior_value").alias("prev_kpi_value"),
        two("feature_value").alias("observed_value"),
        F.col("threshold").alias("threshold_value"),
        "threshold2", "operator", "severity",
        F.round(F.col("feature_value") - F.col("threshold"), 2).alias("breach_delta"),
        detected_at.alias("detected_at"),
        F.lit(False).alias("why_computed"),
        "job_id",
        start.alias("period_start"), end.alias("period_end"),
        window_text(start, end).alias("kpi_query"),
    )


def feature_table(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    dims: Sequence[str],
    window: Window,
    features: Sequence[str],
    filters: dict[str, Sequence[str]] | None = None,
    benchmark: float | None = None,
) -> DataFrame:
    """Requested features of some KPIs by some dimensions, as one long table.

    Snapshot features share one scan. Cross-section features read its current values several
    times, so these are written once instead of scanning the facts again. Series features come
    from one monthly scan that reaches back as far as the longest of them needs. Nothing is
    computed for a feature that was not asked for.
    """
    wanted = list(dict.fromkeys(feature_key(f) for f in features))
    compared = [f for f in wanted if feature_def(f).kind in ("snapshot", "acceleration")]
    series = [f for f in wanted if feature_def(f).kind == "series"]
    cross = [f for f in wanted if feature_def(f).kind == "cross"]
    plan = Comparison(star, kpis, window, compared)
    read = star.sources.get("discount_depth") if "discount_depth" in cross else None
    more = [Value(f"{read}__0", star.kpi(read).measure, window)] if read and read not in kpis else []
    wide = grouped_long(filtered_star(star, tables, dims, plan.windows, filters), star, dims, [*plan.values(), *more])
    if cross or series:
        wide = settled(wide)
    depth = [F.col(f"{read}__0").alias("discount_depth")] if read else []
    now = wide.select("dimension", "dimension_value", *depth, F.inline(F.array(*[
        F.struct(F.lit(k).alias("kpi_name"), F.col(f"{k}__0").alias("kpi_value")) for k in kpis
    ]))).where("kpi_value is not null")
    parts = []
    if compared:
        parts.append(wide.select("dimension", "dimension_value", plan.rows()).where(
            "kpi_value is not null and feature_value is not null").select(*FEATURE_COLUMNS))
    if cross:
        parts.append(cross_section(now, cross, benchmark))
    if series:
        parts.append(_series_part(star, tables, kpis, dims, window, filters, series, now))
    if not parts:
        raise CatalogueError("no feature was requested")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_section(now: DataFrame, features: Sequence[str], benchmark: float | None = None) -> DataFrame:
    """Features that compare the members of one window, or read a column of it."""
    keys = ("kpi_name", "dimension")
    frame = now
    value: dict[str, Column] = {}
    if {"rank", "rank_pct"} & set(features):
        frame = add_rank(frame, within=keys)
        value |= {"rank": F.col("rank"), "rank_pct": F.col("rank_pct")}
    if {"z_score", *MIX_NAMES} & set(features):
        frame = add_period_stats(frame, within=keys)
        value |= {"z_score": F.col("z_score"), **{n: F.col("mix") for n in MIX_NAMES}}
    value["benchmark_variance"] = F.round(benchmark_variance(F.col("kpi_value"), benchmark), 2)
    value["discount_depth"] = pass_through(frame, "discount_depth")
    value["self_kpi_value"] = F.round(F.when(F.col("dimension") == SELF, F.col("kpi_value")), 2)
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature_name"), value.get(f, F.lit(None).cast("double")).alias("feature_value"))
        for f in features
    ])
    return frame.select(
        "kpi_name", "dimension", "dimension_value", "kpi_value",
        F.lit(None).cast("double").alias("prior_value"), F.inline(rows),
    ).where("feature_value is not null").select(*FEATURE_COLUMNS)


def _series_part(star, tables, kpis, dims, window, filters, features, now) -> DataFrame:
    back = max(FEATURES[f].lookback for f in features)
    reach = Window(window.shifted(-back).start, window.end)
    monthly = kpi_series(star, tables, kpis, dims, reach, filters)
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature_name"), F.col(f).alias("feature_value")) for f in features
    ])
    first = window.start.replace(day=1)
    found = (
        add_series_features(monthly, features).where(F.col("period_start") >= F.lit(first))
        .select("kpi_name", "dimension", "dimension_value", F.inline(rows))
        .where("feature_value is not null")
    )
    return found.join(now, ["kpi_name", "dimension", "dimension_value"], "left").select(
        "kpi_name", "dimension", "dimension_value", "feature_name", "kpi_value",
        F.lit(None).cast("double").alias("prior_value"), "feature_value",
    )


def canonical(names: Sequence[str]) -> list[str]:
    cleaned = [SIGNAL_ALIASES.get(n.strip(), n.strip()) for n in names if n and n.strip()]
    return list(dict.fromkeys(cleaned))


@dataclass(frozen=True)
class JobPlan:
    """Jobs that share a star, a window and filters, and so one aggregation."""

    star: Star
    window: Window
    filters: tuple[tuple[str, tuple[str, ...]], ...]
    jobs: tuple[Job, ...]

    @property
    def kpis(self) -> list[str]:
        return list(dict.fromkeys(j.kpi_name for j in self.jobs))

    @property
    def dims(self) -> list[str]:
        return list(dict.fromkeys(SELF if is_self(d) else d for j in self.jobs for d in j.dimensions))

    def features(self, defs: Mapping[str, SignalDef]) -> list[str]:
        names = [n for j in self.jobs for n in canonical(j.signals)]
        return list(dict.fromkeys(feature_key(defs[n].feature_name) for n in names if n in defs))


def plan_jobs(
    stars: Sequence[Star], jobs: Sequence[Job], defs: Mapping[str, SignalDef], default_window: Window
) -> list[JobPlan]:
    """Active jobs with a known signal and KPI, grouped by what they can share; `job_errors` names the others."""
    groups: dict[tuple, list[Job]] = {}
    owners = {k.name: star for star in stars for k in star.kpis}
    for job in jobs:
        if not job.is_active or not any(n in defs for n in canonical(job.signals)):
            continue
        if (star := owners.get(job.kpi_name)) is None:
            continue
        own = job.period_start is not None and job.period_end is not None
        window = Window(job.period_start, job.period_end) if own else default_window
        filters = job_filters(star, job.kpi_name, dict(job.filters))
        key = (star.name, window, tuple(sorted((k, tuple(v)) for k, v in filters.items())))
        groups.setdefault(key, []).append(job)
    by_name = {s.name: s for s in stars}
    return [JobPlan(by_name[n], w, f, tuple(group)) for (n, w, f), group in groups.items()]


def job_errors(spark: SparkSession, stars: Sequence[Star], jobs: Sequence[Job], defs: Sequence[SignalDef]) -> DataFrame:
    """`job_id, kpi_name, error` of the active jobs that cannot run; they do not stop the others."""
    known, names = {k.name for star in stars for k in star.kpis}, {d.signal_name for d in defs}
    rows = []
    for job in jobs:
        if job.is_active and job.kpi_name not in known:
            rows.append((job.job_id, job.kpi_name, f"KPI '{job.kpi_name}' is in no star"))
        elif job.is_active and not any(n in names for n in canonical(job.signals)):
            rows.append((job.job_id, job.kpi_name, "no signal of the job is defined"))
    return inline_rows(spark, rows, "job_id int, kpi_name string, error string")


def detect_jobs(
    spark: SparkSession,
    stars: Sequence[Star],
    tables: Callable[[str], DataFrame],
    jobs: Sequence[Job],
    defs: Sequence[SignalDef],
    default_window: Window,
    detected_at: Column,
    benchmark: float | None = None,
    top_n: bool = True,
) -> DataFrame:
    """Signals of all active jobs; `top_n=False` leaves the definitions' row limits out.

    The number of aggregations follows the distinct settings of the jobs, not the jobs.
    """
    by_name = {d.signal_name: d for d in defs}
    plans = plan_jobs(stars, jobs, by_name, default_window)
    if not plans:
        raise CatalogueError("no active job has a known signal")
    out = None
    for plan in plans:
        part = _detect_plan(spark, plan, tables, by_name, detected_at, benchmark, top_n)
        out = part if out is None else out.unionByName(part)
    return out


def _detect_plan(
    spark: SparkSession, plan: JobPlan, tables: Callable[[str], DataFrame], by_name: Mapping[str, SignalDef],
    detected_at: Column, benchmark: float | None, top_n: bool,
) -> DataFrame:
    rows = [
        (job.job_id, job.kpi_name, SELF if is_self(d) else d, name)
        for job in plan.jobs for name in canonical(job.signals) if name in by_name for d in job.dimensions
    ]
    values = feature_table(plan.star, tables, plan.kpis, plan.dims, plan.window, plan.features(by_name),
                           dict(plan.filters), benchmark)
    wanted = inline_rows(spark, rows, "job_id int, kpi_name string, dimension string, signal_name string")
    defs = signal_defs_frame(spark, [by_name[n] for n in sorted({r[3] for r in rows})])
    hits = detect(values, defs).join(wanted, ["kpi_name", "dimension", "signal_name"])
    limits = [by_name[n].top_n for n in sorted({r[3] for r in rows}) if by_name[n].top_n]
    if limits and top_n:
        hits = worst_first(hits, max(limits), ("job_id", "kpi_name", "dimension", "signal_name"))
    return signal_rows(hits, F.lit(plan.window.start), F.lit(plan.window.end), detected_at)


def entity_counts(signals: DataFrame, dimension: str, at_least: int = 1) -> DataFrame:
    """Members of a dimension with their number of signals, busiest first."""
    return (
        signals.where((F.col("dimension") == dimension) & (F.trim("dimension_value") != ""))
        .groupBy("dimension_value").agg(F.count(F.lit(1)).alias("signal_count"))
        .where(F.col("signal_count") >= max(1, at_least))
        .orderBy(F.desc("signal_count"), "dimension_value")
    )


def counts_by(signals: DataFrame, *columns: str) -> DataFrame:
    return signals.groupBy(*columns).agg(F.count(F.lit(1)).alias("signal_count"))


def worst_first(signals: DataFrame, most: int, group: Sequence[str] = ("kpi_name", "dimension", "signal_name")) -> DataFrame:
    """Keep the `top_n` worst rows of a signal: lowest for lt/lte, highest otherwise.

    Signals without `top_n` keep every row. `most` is the largest `top_n` in use: as a constant
    it lets Spark apply the limit before the shuffle, so a signal with very many rows does not
    pass through one task.
    """
    worst = F.when(F.col("operator").isin("lt", "lte"), F.col("feature_value")).otherwise(-F.col("feature_value"))
    place = F.row_number().over(
        W.partitionBy(*group).orderBy(worst, "dimension_value")
    )
    capped = (
        signals.where("top_n is not null").withColumn("__place", place)
        .where((F.col("__place") <= most) & (F.col("__place") <= F.col("top_n"))).drop("__place")
    )
    return capped.unionByName(signals.where("top_n is null"))


def entity_signals(signals: DataFrame, dimension: str, member: str, kpis: Sequence[str] = (), limit: int = 500) -> DataFrame:
    """One member's signals, newest first."""
    mine = signals.where(
        (F.col("dimension") == dimension) & (F.lower(F.trim("dimension_value")) == member.strip().lower())
    )
    if kpis:
        mine = mine.where(F.col("kpi_name").isin(list(kpis)))
    return mine.orderBy(F.desc("detected_at"), "signal_id").limit(max(1, min(limit, 5000)))


def change_check(signals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Recompute each relative change from its two stored levels and compare with the stored value."""
    expected = pct_change_abs(F.col("current_kpi_value"), F.col("prev_kpi_value"))
    return signals.where("prev_kpi_value is not null").select(
        "signal_id", "kpi_name", "dimension", "dimension_value", "feature_value",
        F.round(expected, 2).alias("expected"),
        (F.abs(F.col("feature_value") - expected) < tolerance).alias("matches"),
    )
