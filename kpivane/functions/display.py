"""Numbers and labels as display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import percent_scale


def trimmed(value: Column, digits: int = 2) -> Column:
    """At most `digits` decimals, trailing zeros removed."""
    text = F.round(value.cast(f"decimal(38,{digits + 4})"), digits).cast("string")
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text


def stored_number(value: Column, missing: str = "None") -> Column:
    """A number with at most two decimals and at least one, never in exponent form."""
    text = F.regexp_replace(value.cast("decimal(38,2)").cast("string"), r"(\.\d)0$", "$1")
    return F.coalesce(text, F.lit(missing))


def plain_number(value: Column, digits: int = 2) -> Column:
    return F.coalesce(trimmed(value, digits), F.lit("n/a"))


def reads_as_percent(name: Column) -> Column:
    """Metric names that suggest a rate or a share."""
    return F.coalesce(F.lower(name).rlike(r"%|percent|pct|rate|\bratio\b"), F.lit(False))


def metric_text(name: Column, value: Column, digits: int = 2) -> Column:
    """`21%` for rate-like metrics, a plain number for others, `n/a` when missing."""
    as_percent = F.concat(trimmed(percent_scale(value), digits), F.lit("%"))
    return F.coalesce(
        F.when(reads_as_percent(name), as_percent).otherwise(trimmed(value, digits)), F.lit("n/a")
    )


def currency_text(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, 2)), F.lit("$0.00"))


def integer_text(value: Column) -> Column:
    """Whole part with thousands separators; the fraction is cut off, not rounded."""
    return F.coalesce(F.format_number(value.cast("bigint"), 0), F.lit("0"))


def decimal_text(value: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_number(value, digits), F.lit("0.00"))


def clipped(text: Column, limit: int) -> Column:
    """Trimmed text, cut to `limit` characters with an ellipsis as the last one."""
    clean = F.coalesce(F.trim(text), F.lit(""))
    return F.when(F.length(clean) > limit, F.concat(F.left(clean, F.lit(limit - 1)), F.lit("…"))).otherwise(clean)


def signed_percent(current: Column, prior: Column) -> Column:
    """`+5.3%`, or `n/a` without a usable base."""
    change = F.try_divide(current - prior, F.abs(prior)) * 100
    number = F.round(change.cast("decimal(38,6)"), 1)
    text = F.concat(F.when(number < 0, "").otherwise("+"), number.cast("string"), F.lit("%"))
    return F.coalesce(text, F.lit("n/a"))
