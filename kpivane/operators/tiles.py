"""KPI tiles and breakdowns: current against an earlier window, with change text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import trimmed
from ..functions.numbers import pct_change_abs, percent_scale
from ..functions.periods import Window, any_window, tile_prior
from ..sources.config import inline_rows
from .model import Kpi, Star, Value
from .query import grouped_long
from .snapshot import filtered_star

# Fixed value: smaller changes read as unchanged.
UNCHANGED = 0.05


def slice_members(text: str | Sequence[str]) -> tuple[str, ...]:
    """Comma-separated members, trimmed, without blanks or repeats."""
    items = text.split(",") if isinstance(text, str) else [p for t in text for p in t.split(",")]
    return tuple(dict.fromkeys(p.strip() for p in items if p.strip()))


def tile_change(kpi: Kpi, now: Column, before: Column) -> tuple[Column, Column]:
    """Change and its unit: points at two decimals, percent at one."""
    both = now.isNotNull() & before.isNotNull()
    if kpi.points:
        change = F.round(percent_scale(now) - percent_scale(before), 2)
        return change, F.when(both, "percentage_points")
    if kpi.format == "percentage":
        now, before = percent_scale(now), percent_scale(before)
    change = F.round(pct_change_abs(now, before), 1)
    return change, F.when(change.isNotNull(), "percent")


def change_text(now: Column, before: Column, change: Column, unit: Column, grain: str) -> Column:
    name = f"previous {grain}"
    size = F.abs(change)
    suffix = F.when(unit == "percentage_points", " pp").otherwise("%")
    moved = F.when(change > 0, f" increase from {name}").otherwise(f" decrease from {name}")
    return (
        F.when(now.isNull(), F.lit(None).cast("string"))
        .when(before.isNull(), f"No {name} value available")
        .when(change.isNull(), f"Previous {grain} value was zero")
        .when(size < UNCHANGED, f"Unchanged from {name}")
        .otherwise(F.concat(trimmed(size), suffix, moved))
    )


def _tile_rows(star: Star, kpis: Sequence[str], grain: str) -> Column:
    return F.inline(F.array(*_tile_structs(star, kpis, grain)))


def _tile_structs(star: Star, kpis: Sequence[str], grain: str, prefix: str = "", label: str | None = None) -> list[Column]:
    rows = []
    for name in kpis:
        kpi = star.kpi(name)
        now, before = F.col(f"{prefix}{name}__now"), F.col(f"{prefix}{name}__before")
        change, unit = tile_change(kpi, now, before)
        rows.append(F.struct(
            *([F.lit(label).alias("window")] if label is not None else []), F.lit(name).alias("kpi_name"), now.alias("value"), before.alias("previous_value"),
            change.alias("change"), unit.alias("change_unit"),
            change_text(now, before, change, unit, grain).alias("comparison_text"),
        ))
    return rows


def _pair(star: Star, kpis: Sequence[str], window: Window, before: Window, prefix: str = "") -> list[Value]:
    return [
        Value(f"{prefix}{k}__{s}", star.kpi(k).measure, w)
        for k in kpis for s, w in (("now", window), ("before", before))
    ]


def tiles(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    window: Window,
    grain: str = "month",
    slices: Mapping[str, str | Sequence[str]] | None = None,
) -> DataFrame:
    """One row per KPI: total now, total in the shifted window, change and its text."""
    before = tile_prior(window, grain)
    members = {d: slice_members(v) for d, v in (slices or {}).items() if slice_members(v)}
    frame = filtered_star(star, tables, (), [window, before], members)
    return frame.agg(*[v.aggregate(F.col(star.date_column)) for v in _pair(star, kpis, window, before)]).select(_tile_rows(star, kpis, grain))


def requested_tiles(spark: SparkSession, star: Star, rows: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Every requested KPI keeps a row; an unknown one carries an error and does not stop the others."""
    asked = inline_rows(spark, [(i, k) for i, k in enumerate(requested)], "position int, requested string")
    known = {k.name.lower() for k in star.kpis}
    joined = asked.join(rows, F.lower("requested") == F.lower("kpi_name"), "left")
    return joined.select(
        F.col("requested").alias("kpi_name"), "value", "previous_value", "change", "change_unit", "comparison_text",
        F.when(~F.lower("requested").isin(list(known)),
               F.concat(F.lit("KPI '"), F.col("requested"), F.lit("' not found"))).alias("error"),
    )


def breakdown(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    dims: Sequence[str],
    window: Window,
    filters: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """KPIs by each dimension; blank members and missing values are dropped."""
    frame = filtered_star(star, tables, dims, [window], filters)
    wide = grouped_long(frame, star, dims, [Value(k, star.kpi(k).measure) for k in kpis])
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("kpi_name"), F.col(k).alias("value")) for k in kpis]))
    return (
        wide.select("dimension", F.trim("dimension_value").alias("dimension_value"), rows)
        .where("dimension_value <> '' and value is not null")
        .select("kpi_name", "dimension", "dimension_value", "value")
    )


def breakdown_windows(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    dims: Sequence[str],
    windows: Mapping[str, Window],
    filters: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The breakdown for several labelled windows (monthly and weekly) from one scan."""
    frame = filtered_star(star, tables, dims, list(windows.values()), filters)
    values = [Value(f"{label}__{k}", star.kpi(k).measure, w) for label, w in windows.items() for k in kpis]
    rows = F.inline(F.array(*[
        F.struct(F.lit(label).alias("window"), F.lit(k).alias("kpi_name"), F.col(f"{label}__{k}").alias("value"))
        for label in windows for k in kpis
    ]))
    return (
        grouped_long(frame, star, dims, values)
        .select("dimension", F.trim("dimension_value").alias("dimension_value"), rows)
        .where("dimension_value <> '' and value is not null")
        .select("window", "kpi_name", "dimension", "dimension_value", "value")
    )


def tile_windows(
    star: Star, tables: Callable[[str], DataFrame], kpis: Sequence[str], windows: Mapping[str, tuple[str, Window]]
) -> DataFrame:
    """Tiles for several labelled `(grain, window)` pairs from one scan."""
    priors = {label: tile_prior(w, grain) for label, (grain, w) in windows.items()}
    spans = [*[w for _, w in windows.values()], *priors.values()]
    frame = filtered_star(star, tables, (), spans)
    wide = frame.agg(*[
        v.aggregate(F.col(star.date_column))
        for label, (_, w) in windows.items() for v in _pair(star, kpis, w, priors[label], f"{label}__")
    ])
    return wide.select(F.inline(F.array(*[
        row for label, (grain, _) in windows.items() for row in _tile_structs(star, kpis, grain, f"{label}__", label)
    ])))


# Parent names that mean the whole portfolio.
PORTFOLIO_PARENTS = frozenset({"", "kpi_portfolio", "kpi", "portfolio"})


def parent_key(name: str | None) -> str:
    return "_".join((name or "").strip().lower().replace("-", " ").split())


def insight_breakdown(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    dims: Sequence[str],
    window: Window,
    parent: str | None = None,
    member: str | None = None,
) -> DataFrame:
    """One parent slice by every other dimension, now against the month before.

    Conditional aggregation keeps a member that occurs in either window, with NULL for the other.
    """
    whole = parent_key(parent) in PORTFOLIO_PARENTS
    if not whole and not (member or "").strip():
        raise ValueError("a slice-level parent needs its member")
    children = [d for d in dims if whole or parent_key(d) != parent_key(parent)]
    before = window.shifted(-1)
    filters = {} if whole else {star.dimension(parent).name: [member]}
    frame = filtered_star(star, tables, children, [window, before], filters)
    wide = grouped_long(frame, star, children, _pair(star, kpis, window, before))
    return (
        wide.select("dimension", F.trim("dimension_value").alias("dimension_value"), _tile_rows(star, kpis, "month"))
        .where("dimension_value <> '' and (value is not null or previous_value is not null)")
    )
