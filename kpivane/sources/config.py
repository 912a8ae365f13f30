"""Configuration: declared schemas, KPI resolution, jobs and thresholds as DataFrames.

Configuration is written by people and is small; it becomes inline rows, whose known size lets
Spark broadcast it by its own rule. Jobs may also come as a table of any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.model import CatalogueError, Star

STRING_MAP = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

# Retired signal names and the names that replaced them.
SIGNAL_ALIASES = {"week_spike": "weekly_growth", "week_drop": "weekly_degrowth"}


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


KPI_SCHEMA = "kpi_name string, measure string, label string, format string, description string, pp_difference boolean"
VALID_DIMENSION_SCHEMA = "kpi_name string, dimension_name string, is_valid boolean"
DIMENSION_SCHEMA = "dimension_name string, table_name string, column_name string"
DEPENDENCY_SCHEMA = "parent_kpi string, dependent_kpi string, label string, sort_order int"
SIGNAL_SCHEMA = (
    "signal_name string, feature_name string, operator string, threshold double, threshold2 double, "
    "severity string, format string, top_n int, overrides map<string,double>"
)
THRESHOLD_SCHEMA = "kpi_name string, dimension_name string, operator string, threshold double, severity string"
JOB_SCHEMA = (
    "job_id int, kpi_name string, dimensions array<string>, features array<string>, signals array<string>, "
    "filters map<string,array<string>>, period_start date, period_end date, is_active boolean"
)


@dataclass(frozen=True)
class SignalDef:
    signal_name: str
    feature_name: str
    operator: str
    threshold: float
    threshold2: float | None = None
    severity: str = "info"
    format: str = "percentage"
    top_n: int | None = None
    overrides: dict[str, float] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Job:
    job_id: int
    kpi_name: str
    dimensions: tuple[str, ...]
    signals: tuple[str, ...]
    filters: tuple[tuple[str, tuple[str, ...]], ...] = ()
    period_start: date | None = None
    period_end: date | None = None
    is_active: bool = True
    features: tuple[str, ...] = ()


def _literal(value: Any, type_: T.DataType) -> str:
    """A configuration value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(type_, T.ArrayType):
        return f"array({', '.join(_literal(v, type_.elementType) for v in value)})"
    if isinstance(type_, T.MapType):
        pairs = [x for k, v in value.items() for x in (_literal(k, type_.keyType), _literal(v, type_.valueType))]
        return f"map({', '.join(pairs)})"
    if isinstance(type_, T.BooleanType):
        return str(bool(value)).upper()
    if isinstance(type_, T.DateType):
        return f"DATE'{value.isoformat()}'"
    if isinstance(type_, T.DoubleType):
        return f"{float(value)!r}D"
    if isinstance(type_, T.StringType):
        return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(int(value))


def inline_rows(spark: SparkSession, rows: Sequence[Sequence], ddl: str) -> DataFrame:
    """Configuration rows as an inline table: no Python worker, and a size Spark knows."""
    fields = _schema(ddl).fields
    if not rows:
        return spark.createDataFrame([], _schema(ddl))
    values = ", ".join(f"({', '.join(_literal(v, f.dataType) for v, f in zip(row, fields))})" for row in rows)
    names = ", ".join(f"c{i}" for i in range(len(fields)))
    typed = ", ".join(f"CAST(c{i} AS {f.dataType.simpleString()}) AS {f.name}" for i, f in enumerate(fields))
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS rows({names})")


def signal_defs_frame(spark: SparkSession, defs: Sequence[SignalDef]) -> DataFrame:
    return inline_rows(spark, [
        (d.signal_name, d.feature_name, d.operator, d.threshold, d.threshold2, d.severity, d.format, d.top_n, d.overrides)
        for d in defs
    ], SIGNAL_SCHEMA)


def jobs_frame(spark: SparkSession, jobs: Sequence[Job]) -> DataFrame:
    return inline_rows(spark, [
        (j.job_id, j.kpi_name, j.dimensions, j.features, j.signals, {k: list(v) for k, v in j.filters},
         j.period_start, j.period_end, j.is_active)
        for j in jobs
    ], JOB_SCHEMA)


def catalogue_frames(spark: SparkSession, stars: Sequence[Star]) -> dict[str, DataFrame]:
    """KPI, dimension, valid-dimension and dependency frames of a set of stars."""
    kpis, valid, dims, deps = [], [], {}, []
    for star in stars:
        for d in star.dimensions:
            table = star.links[d.via[-1]].table if d.via else star.fact
            dims.setdefault(d.name, (d.name, table, d.expr))
        for k in star.kpis:
            kpis.append((k.name, repr(k.measure), k.label or k.name, k.format, k.description, k.points))
            valid += [(k.name, d, True) for d in star.dims_of(k.name)]
            deps += [(k.name, dep, f"{k.name} driver", i) for i, dep in enumerate(k.depends_on, 1)]
    return {
        "kpi": inline_rows(spark, kpis, KPI_SCHEMA),
        "valid_dimension": inline_rows(spark, valid, VALID_DIMENSION_SCHEMA),
        "dimension": inline_rows(spark, list(dims.values()), DIMENSION_SCHEMA),
        "dependency": inline_rows(spark, deps, DEPENDENCY_SCHEMA),
    }


def resolve_kpis(kpi: DataFrame, valid: DataFrame, dimension: DataFrame, dependency: DataFrame) -> DataFrame:
    """One row per KPI and valid dimension, with the KPI's dependencies in order."""
    deps = dependency.groupBy("parent_kpi").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "dependent_kpi"))),
                                 lambda s: s["dependent_kpi"]), ",").alias("dependencies"))
    return (
        kpi.join(valid.where("is_valid"), "kpi_name")
        .join(dimension, "dimension_name")
        .join(deps, F.col("kpi_name") == F.col("parent_kpi"), "left")
        .select("kpi_name", "format", "dimension_name", "table_name", "column_name", "dependencies")
    )


def check_catalogue(stars: Sequence[Star]) -> None:
    """Fail before any job runs when a KPI, dimension, link or dependency is not mapped."""
    for star in stars:
        for d in star.dimensions:
            if not d.expr or any(step not in star.links for step in d.via):
                raise CatalogueError(f"Dimension '{d.name}' of '{star.name}' lacks its table or column")
        for k in star.kpis:
            for name in star.dims_of(k.name):
                star.dimension(name)
            for name in k.depends_on:
                star.kpi(name)


def canonical_signals(names: Column) -> Column:
    """Trimmed signal names, retired ones replaced, blanks and repeats removed, order kept."""
    mapping = F.create_map(*[F.lit(x) for pair in SIGNAL_ALIASES.items() for x in pair])
    renamed = F.transform(names, lambda n: F.coalesce(F.element_at(mapping, F.trim(n)), F.trim(n)))
    return F.array_distinct(F.filter(renamed, lambda n: n != ""))


def expand_jobs(jobs: DataFrame, active_only: bool = True) -> DataFrame:
    """One row per job and dimension; a job without dimensions keeps one blank row.

    `filters` may hold scalars or lists as JSON text (`raw_filters`), or be a map already. The
    `period` entry is split off; dates that cannot be read become NULL.
    """
    if "raw_filters" in jobs.columns:
        entries = F.coalesce(
            F.from_json("raw_filters", "map<string,string>"),
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
        )
        members = F.map_filter(entries, lambda k, v: (k != "period") & v.isNotNull() & ~v.startswith("{"))
        lists = F.transform_values(
            members, lambda _, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
        )
        period = F.from_json(F.element_at(entries, "period"), "start string, end string")
        jobs = jobs.withColumns({
            "filters": lists,
            "period_start": F.try_to_date(period["start"], "yyyy-MM-dd"),
            "period_end": F.try_to_date(period["end"], "yyyy-MM-dd"),
        }).drop("raw_filters")
    if active_only:
        jobs = jobs.where("is_active")
    dims = F.when(F.size("dimensions") > 0, F.col("dimensions")).otherwise(F.array(F.lit("")))
    return jobs.withColumns({"signals": canonical_signals(F.col("signals"))}).select(
        *[c for c in jobs.columns if c not in ("dimensions", "signals")],
        "signals", F.explode(dims).alias("dimension_name"),
    )


def select_jobs(
    jobs: DataFrame,
    kpi: str | None = None,
    job_ids: Sequence[int] = (),
    excluded_kpis: Sequence[str] = (),
    dimension: str | None = None,
) -> DataFrame:
    """Choose expanded jobs; exclusion and dimension ignore case."""
    if kpi:
        jobs = jobs.where(F.col("kpi_name") == kpi)
    if job_ids:
        jobs = jobs.where(F.col("job_id").isin(list(job_ids)))
    if excluded_kpis:
        jobs = jobs.where(~F.lower("kpi_name").isin([k.strip().lower() for k in excluded_kpis]))
    if dimension:
        jobs = jobs.where(F.lower("dimension_name") == dimension.strip().lower())
    return jobs


def job_windows(jobs: DataFrame, default_start: Column, default_end: Column) -> DataFrame:
    """Window of each job: its own period when complete, else the default."""
    own = F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    return jobs.withColumns({
        "window_start": F.when(own, F.col("period_start")).otherwise(default_start),
        "window_end": F.when(own, F.col("period_end")).otherwise(default_end),
    })


def threshold_cascade(pairs: DataFrame, thresholds: DataFrame, jobs: DataFrame, signals: DataFrame) -> DataFrame:
    """Thresholds of each (KPI, dimension): exact rows, else any-dimension rows, else job signals.

    The last step takes the signals of the KPI's active jobs, with a per-dimension override.
    """
    exact = pairs.join(thresholds, ["kpi_name", "dimension_name"]).withColumn("priority", F.lit(1))
    general = pairs.join(
        thresholds.where("dimension_name is null").drop("dimension_name"), "kpi_name"
    ).withColumn("priority", F.lit(2))
    names = (
        jobs.where("is_active")
        .select("kpi_name", F.explode(canonical_signals(F.col("signals"))).alias("signal_name")).distinct()
    )
    by_job = (
        pairs.join(names, "kpi_name").join(signals, "signal_name")
        .select(
            "kpi_name", "dimension_name", "operator",
            F.coalesce(F.element_at("overrides", F.col("dimension_name")), F.col("threshold")).alias("threshold"),
            "severity", F.lit(3).alias("priority"),
        )
    )
    columns = ["kpi_name", "dimension_name", "operator", "threshold", "severity", "priority"]
    every = exact.select(columns).unionByName(general.select(columns)).unionByName(by_job.select(columns))
    best = F.min("priority").over(W.partitionBy("kpi_name", "dimension_name"))
    return every.withColumn("best", best).where("priority = best").drop("best")


def push_period(jobs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Write a period into every job's filters, keeping its other keys."""
    kept = F.map_filter(F.coalesce(F.col("filters"), F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<array<string>>"))), lambda k, _: k != "period")
    period = F.create_map(F.lit("period"), F.array(start.cast("string"), end.cast("string")))
    return jobs.withColumns({
        "filters": F.map_concat(kept, period), "period_start": start, "period_end": end,
    })
