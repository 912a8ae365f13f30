"""End-to-end run: signals, then WHY rows, then clusters, each written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import Window
from ..operators.clusters import MEMBER_CHARS, dimensional_clusters, rollup_clusters, standard_clusters
from ..operators.features import feature_def
from ..operators.model import Star, is_self
from ..operators.signals import detect_jobs, plan_jobs
from ..operators.why import WHY_COLUMNS, explain
from ..sources.config import Job, SignalDef, check_catalogue
from ..sources.stage import settled


@dataclass(frozen=True)
class Results:
    """The written tables of one run."""

    signals: DataFrame
    whys: DataFrame
    standard: DataFrame
    dimensional: DataFrame
    rollup: DataFrame

    def counts(self) -> DataFrame:
        """Rows of each stage."""
        out = None
        for name in ("signals", "whys", "standard", "dimensional", "rollup"):
            one = getattr(self, name).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stage"), "rows")
            out = one if out is None else out.unionByName(one)
        return out


def explain_jobs(
    signals: DataFrame,
    stars: Sequence[Star],
    tables: Callable[[str], DataFrame],
    jobs: Sequence[Job],
    defs: Sequence[SignalDef],
    default_window: Window,
    run_at: Column,
) -> DataFrame:
    """WHY rows of the signals of all jobs, one drill scan for each group of jobs that can share it."""
    by_name = {d.signal_name: d for d in defs}
    out = None
    for plan in plan_jobs(stars, jobs, by_name, default_window):
        features = [f for f in plan.features(by_name) if feature_def(f).kind == "snapshot"]
        dims = [d for d in plan.dims if not is_self(d)]
        if not features or not dims:
            continue
        mine = signals.where(F.col("job_id").isin([j.job_id for j in plan.jobs]))
        part = explain(mine, plan.star, tables, plan.kpis, dims, plan.window, features, run_at, dict(plan.filters))
        out = part if out is None else out.unionByName(part)
    if out is None:
        empty = signals.where(F.lit(False)).select("signal_id")
        return empty.select(*[F.lit(None).cast("string").alias(c) for c in WHY_COLUMNS])
    return out


def run(
    spark: SparkSession,
    stars: Sequence[Star],
    tables: Callable[[str], DataFrame],
    jobs: Sequence[Job],
    defs: Sequence[SignalDef],
    window: Window,
    run_at: Column,
    cluster_dims: Sequence[str],
    write: Callable[[str, DataFrame], DataFrame] | None = None,
) -> Results:
    """Run all stages. `write` stores a named table and returns it as read back."""
    store = write or (lambda _name, frame: settled(frame))
    check_catalogue(stars)
    signals = store("signals", detect_jobs(spark, stars, tables, jobs, defs, window, run_at))
    whys = store("whys", explain_jobs(signals, stars, tables, jobs, defs, window, run_at))
    kpis = signals.select("kpi_name").distinct()
    return Results(
        signals, whys,
        store("standard", standard_clusters(signals, whys, member_chars=MEMBER_CHARS)),
        store("dimensional", dimensional_clusters(signals, whys, cluster_dims)),
        store("rollup", rollup_clusters(signals, whys, kpis, F.lit(window.start), F.lit(window.end))),
    )
