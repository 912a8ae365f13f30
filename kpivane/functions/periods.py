"""Reporting windows: driver-side for job parameters, Columns for tables of windows."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comparison rules, tried in this order against the feature name.
#   back N days    -> [start - N days, start - 1 day]
#   shift N months -> both ends N months earlier
#   lead N months  -> [start - N months, start - 1 day]
PRIOR_RULES: tuple[tuple[str, str, int], ...] = (
    ("wow", "back", 7),
    ("wom", "back", 7),
    ("mom", "shift", 1),
    ("yoy", "shift", 12),
    ("qoq", "shift", 3),
    ("acceleration", "lead_by_length", 1),
    ("kpi_vs_rolling", "lead", 3),
    ("rolling_avg_6m", "lead", 6),
    ("rolling_avg_12m", "lead", 12),
    ("rolling_avg", "lead", 3),
    ("std_dev_3m", "lead", 3),
    ("std_dev", "lead", 6),
    ("growth", "growth", 1),
)
SHORT_WINDOW_DAYS = 14

# Window length (days, inclusive) up to which an acceleration uses each grain.
ACCELERATION_GRAINS: tuple[tuple[int, str], ...] = (
    (14, "wow_growth_pct"),
    (95, "mom_growth_pct"),
    (100, "qoq_growth_pct"),
)
LONGEST_GRAIN = "yoy_growth_pct"


def shift_months(day: date, months: int) -> date:
    """`day` moved by whole months, clipped to the month's last day."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


@dataclass(frozen=True)
class Window:
    """An inclusive range of days."""

    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1

    def covers(self, column: Column) -> Column:
        """Half-open test on the raw column, so it works for timestamps and reaches the scan."""
        return (column >= F.lit(self.start)) & (column < F.lit(self.end + timedelta(days=1)))

    def shifted(self, months: int) -> Window:
        return Window(shift_months(self.start, months), shift_months(self.end, months))

    def preceding(self) -> Window:
        """The equal-length window that ends the day before this one starts."""
        return self.moved(-self.days)

    def moved(self, days: int) -> Window:
        step = timedelta(days=days)
        return Window(self.start + step, self.end + step)

    def lead_in(self, *, months: int = 0, days: int = 0) -> Window:
        begin = shift_months(self.start, -months) - timedelta(days=days)
        return Window(begin, self.start - timedelta(days=1))


def any_window(column: Column, windows: list[Window]) -> Column:
    """True when the day falls in any of the windows; overlapping windows are merged first."""
    merged: list[Window] = []
    for item in sorted(set(windows), key=lambda w: (w.start, w.end)):
        if merged and item.start <= merged[-1].end + timedelta(days=1):
            merged[-1] = Window(merged[-1].start, max(merged[-1].end, item.end))
        else:
            merged.append(item)
    test = merged[0].covers(column)
    for item in merged[1:]:
        test = test | item.covers(column)
    return test


def prior_window(feature: str, window: Window) -> Window:
    """The comparison window a feature asks for."""
    rule, amount = next(((r, n) for key, r, n in PRIOR_RULES if key in feature), ("preceding", 0))
    short = window.days <= SHORT_WINDOW_DAYS
    if rule == "back":
        return window.lead_in(days=amount)
    if rule == "shift":
        return window.shifted(-amount)
    if rule == "lead":
        return window.lead_in(months=amount)
    if rule == "lead_by_length":
        return window.lead_in(days=7) if short else window.lead_in(months=amount)
    if rule == "growth" and not short:
        return window.shifted(-amount)
    return window.preceding()


def prior_window_columns(feature: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """`prior_window` for a table that holds one feature and one window per row."""
    span = F.datediff(end, start) + 1
    short = span <= SHORT_WINDOW_DAYS
    before = F.date_sub(start, 1)
    earlier = F.date_sub(start, span)

    def months_back(day: Column, months: int) -> Column:
        return F.add_months(day, -months)

    begin: Column | None = None
    finish: Column | None = None
    for key, rule, amount in PRIOR_RULES:
        if rule == "back":
            pair = (F.date_sub(start, amount), before)
        elif rule == "shift":
            pair = (months_back(start, amount), months_back(end, amount))
        elif rule == "lead":
            pair = (months_back(start, amount), before)
        elif rule == "lead_by_length":
            pair = (F.when(short, F.date_sub(start, 7)).otherwise(months_back(start, amount)), before)
        else:
            pair = (
                F.when(short, earlier).otherwise(months_back(start, amount)),
                F.when(short, before).otherwise(months_back(end, amount)),
            )
        named = feature.contains(key)
        begin = F.when(named, pair[0]) if begin is None else begin.when(named, pair[0])
        finish = F.when(named, pair[1]) if finish is None else finish.when(named, pair[1])
    return begin.otherwise(earlier), finish.otherwise(before)


def tile_prior(window: Window, grain: str) -> Window:
    """Tile comparison: a month earlier, or one window length earlier for weeks."""
    return window.preceding() if grain == "week" else window.shifted(-1)


def week_of(day: date) -> Window:
    """Monday to Sunday around a day."""
    monday = day - timedelta(days=day.weekday())
    return Window(monday, monday + timedelta(days=6))


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def month_start(day: Column) -> Column:
    return F.trunc(day.cast("date"), "month")


def month_index(day: Column) -> Column:
    """Months since year 0, so calendar gaps can be seen by a RANGE frame."""
    return F.year(day) * 12 + F.month(day) - 1


def quarter_index(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day) - 1


def acceleration_grain(days: int, explicit: str | None = None) -> str:
    """Growth feature whose comparison window an acceleration follows."""
    if explicit:
        return explicit
    return next((name for limit, name in ACCELERATION_GRAINS if days <= limit), LONGEST_GRAIN)


def acceleration_grain_column(days: Column) -> Column:
    chain = None
    for limit, name in ACCELERATION_GRAINS:
        chain = F.when(days <= limit, name) if chain is None else chain.when(days <= limit, name)
    return chain.otherwise(LONGEST_GRAIN)


def period_label(start: Column, end: Column) -> Column:
    """`15-21 Mar`, `15 Feb–3 Mar 2026` across months, ISO dates across years."""
    def day(value: Column) -> Column:
        return F.dayofmonth(value).cast("string")

    def month(value: Column) -> Column:
        return F.date_format(value, "MMM")

    same_year = F.year(start) == F.year(end)
    same_month = same_year & (F.month(start) == F.month(end))
    return (
        F.when(same_month, F.concat(day(start), F.lit("-"), day(end), F.lit(" "), month(start)))
        .when(
            same_year,
            F.concat(
                day(start), F.lit(" "), month(start), F.lit("–"),
                day(end), F.lit(" "), month(end), F.lit(" "), F.year(end).cast("string"),
            ),
        )
        .when(start.isNotNull() & end.isNotNull(),
              F.concat(start.cast("string"), F.lit("–"), end.cast("string")))
    )


# Fixed value: the text form in which a query records its date window.
CALENDAR_PATTERN = (
    r"(?is)CALENDAR\s*\(\s*DATE\s*\(\s*(\d{4})\s*,\s*(\d{1,2})\s*,\s*(\d{1,2})\s*\)\s*,"
    r"\s*DATE\s*\(\s*(\d{4})\s*,\s*(\d{1,2})\s*,\s*(\d{1,2})\s*\)\s*\)"
)


def window_from_text(text: Column) -> tuple[Column, Column]:
    """First recorded date window in a text, ends swapped when reversed, NULL when unusable."""
    def part(index: int) -> Column:
        return F.lpad(F.regexp_extract(text, CALENDAR_PATTERN, index), 2, "0")

    def day(first: int) -> Column:
        year = F.regexp_extract(text, CALENDAR_PATTERN, first)
        return F.try_to_date(F.concat_ws("-", year, part(first + 1), part(first + 2)), "yyyy-MM-dd")

    one, two = day(1), day(4)
    usable = one.isNotNull() & two.isNotNull()
    return F.when(usable, F.least(one, two)), F.when(usable, F.greatest(one, two))


def window_text(start: Column, end: Column) -> Column:
    """The recorded form of a window, readable by `window_from_text`."""
    def call(day: Column) -> Column:
        return F.concat(
            F.lit("DATE("), F.year(day).cast("string"), F.lit(","), F.month(day).cast("string"),
            F.lit(","), F.dayofmonth(day).cast("string"), F.lit(")"),
        )

    return F.concat(F.lit("CALENDAR("), call(start), F.lit(","), call(end), F.lit(")"))
