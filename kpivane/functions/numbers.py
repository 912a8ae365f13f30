"""Numeric rules shared by every operator. All of them are plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: at or below this magnitude a rate is read as a fraction, above it as a percentage.
FRACTION_LIMIT = 1.0000001


def finite(value: Column) -> Column:
    """NaN and infinities become NULL, because Spark orders NaN above every number."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def percent_scale(value: Column) -> Column:
    """A stored rate on the 0-100 scale."""
    return F.when(F.abs(value) <= FRACTION_LIMIT, value * 100).otherwise(value)


def pct_change(current: Column, prior: Column) -> Column:
    """Relative change with a signed base, NULL when the base is zero or missing."""
    return F.try_divide(current - prior, prior) * 100


def pct_change_abs(current: Column, prior: Column) -> Column:
    """Relative change with an absolute base, NULL when the base is zero or missing."""
    return F.try_divide(current - prior, F.abs(prior)) * 100


def snapshot_change(
    current: Column, prior: Column, *, fmt: str = "number", points: bool = False, absolute: bool = False
) -> Column:
    """Change between two window values under the KPI's own rules.

    Point KPIs give a percentage-point difference in every case; percentage KPIs compare on the
    0-100 scale; all others compare as they are.
    """
    if points:
        return percent_scale(current) - percent_scale(prior)
    if absolute:
        return current - prior
    if fmt == "percentage":
        return pct_change_abs(percent_scale(current), percent_scale(prior))
    return pct_change_abs(current, prior)


def direction(current: Column, prior: Column, missing: str = "n/a") -> Column:
    """`up`, `down` or `flat`, and `missing` when either side is absent."""
    return (
        F.when(current.isNull() | prior.isNull(), missing)
        .when(current > prior, "up")
        .when(current < prior, "down")
        .otherwise("flat")
    )


def breaches(operator: Column, value: Column, low: Column, high: Column) -> Column:
    """Threshold test. Unknown operators and `between` without an upper bound never fire."""
    hit = (
        F.when(operator == "lt", value < low)
        .when(operator == "gt", value > low)
        .when(operator == "lte", value <= low)
        .when(operator == "gte", value >= low)
        .when(operator == "between", (value >= low) & (value <= high))
    )
    return F.coalesce(hit, F.lit(False))
