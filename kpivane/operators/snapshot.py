"""Window-against-window features: one scan, conditional aggregates, no join of periods."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pct_change_abs, percent_scale, snapshot_change
from ..functions.periods import Window, acceleration_grain, any_window, prior_window
from .features import feature_def, feature_key
from .model import Kpi, Star, Value, is_self
from .query import KpiQuery, grouped_long


def windows_for(feature: str, window: Window, grain: str | None = None) -> list[Window]:
    """The comparison windows a snapshot feature reads, nearest first."""
    name = feature_key(feature)
    if feature_def(name).kind == "acceleration":
        base = acceleration_grain(window.days, grain)
        one = prior_window(base, window)
        return [one, prior_window(base, one)]
    return [prior_window(name, window)]


def acceleration_change(kpi: Kpi, now: Column, one: Column, two: Column, absolute: bool) -> Column:
    if kpi.points:
        now, one, two = map(percent_scale, (now, one, two))
    if kpi.points or absolute:
        return (now - one) - (one - two)
    if kpi.format == "percentage":
        now, one, two = map(percent_scale, (now, one, two))
    return pct_change_abs(now, one) - pct_change_abs(one, two)


def feature_value(kpi: Kpi, feature: str, now: Column, priors: Sequence[Column]) -> Column:
    name = feature_key(feature)
    if len(priors) == 2:
        return acceleration_change(kpi, now, priors[0], priors[1], "abs" in name)
    return snapshot_change(now, priors[0], fmt=kpi.format, points=kpi.points, absolute="growth_abs" in name)


def filtered_star(
    star: Star,
    tables: Callable[[str], DataFrame],
    dims: Sequence[str],
    windows: Sequence[Window],
    filters: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Star rows of any of the windows, under member filters."""
    query = KpiQuery(star, tables, dims=tuple(d for d in dims if not is_self(d)))
    for name, values in (filters or {}).items():
        query = query.member(name, tuple(values))
    return query.filtered().where(any_window(F.col(star.date_column), list(windows)))


class Comparison:
    """Current window against every window that some features need.

    Features that read the same window share its aggregates.
    """

    def __init__(self, star: Star, kpis: Sequence[str], window: Window, features: Sequence[str],
                 grain: str | None = None) -> None:
        self.star, self.kpis = star, list(kpis)
        self.needed = {feature_key(f): windows_for(f, window, grain) for f in features}
        self.windows = list(dict.fromkeys([window, *[w for ws in self.needed.values() for w in ws]]))

    def values(self) -> list[Value]:
        return [
            Value(f"{k}__{i}", self.star.kpi(k).measure, w) for k in self.kpis for i, w in enumerate(self.windows)
        ]

    def rows(self) -> Column:
        """One struct per KPI and feature, to be unnested from a row of aggregates."""
        out = []
        for name in self.kpis:
            kpi, now = self.star.kpi(name), F.col(f"{name}__0")
            for feature, windows in self.needed.items():
                priors = [F.col(f"{name}__{self.windows.index(w)}") for w in windows]
                out.append(F.struct(
                    F.lit(name).alias("kpi_name"),
                    F.lit(feature).alias("feature_name"),
                    now.alias("kpi_value"),
                    priors[0].alias("prior_value"),
                    F.round(feature_value(kpi, feature, now, priors), 2).alias("feature_value"),
                ))
        return F.inline(F.array(*out))


def snapshot(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    dims: Sequence[str],
    window: Window,
    features: Sequence[str],
    filters: Mapping[str, Sequence[str]] | None = None,
    grain: str | None = None,
) -> DataFrame:
    """Long rows `(kpi, dimension, member, feature, kpi_value, prior_value, feature_value)`.

    A member without a value in a needed window gives no row.
    """
    plan = Comparison(star, kpis, window, features, grain)
    frame = filtered_star(star, tables, dims, plan.windows, filters)
    wide = grouped_long(frame, star, dims, plan.values())
    return wide.select("dimension", "dimension_value", plan.rows()).where(
        "kpi_value is not null and feature_value is not null"
    )
