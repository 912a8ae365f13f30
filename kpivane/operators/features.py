"""Series and cross-section features over a long table of KPI values.

Every series feature is a Column over one shared window (member, ordered by month), so Spark
sorts once for all of them. A member's series is bounded by the number of periods. Features that
compare all members of a period use grouped aggregates joined back, never a window over them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.numbers import finite, pct_change, percent_scale
from ..functions.periods import Window, month_index, month_start, quarter_index
from .model import Star, Value
from .query import KpiQuery, grouped_long

MEMBER = ("kpi_name", "dimension", "dimension_value")
PERIOD = ("kpi_name", "dimension", "period_start")


@dataclass(frozen=True)
class Series:
    """One member's values over time, as window expressions."""

    keys: Sequence[str] = MEMBER
    period: str = "period_start"

    @property
    def by_row(self):
        return W.partitionBy(*self.keys).orderBy(self.period)

    def by_index(self, index: Column):
        return W.partitionBy(*self.keys).orderBy(index)

    def lag(self, value: Column, n: int = 1) -> Column:
        return F.lag(value, n).over(self.by_row)

    def rows(self, n: int):
        """The last `n` rows, this one included."""
        return self.by_row.rowsBetween(-(n - 1), 0)

    def months(self, n: int):
        """From `n` calendar months back to this month, whatever rows exist."""
        return self.by_index(month_index(F.col(self.period))).rangeBetween(-n, 0)

    def calendar(self, value: Column, grain: str, n: int = 1) -> Column:
        """Value exactly `n` calendar periods earlier, NULL when that period has no row."""
        day = F.col(self.period)
        index = {"month": month_index, "quarter": quarter_index, "year": F.year}[grain](day)
        return F.max(value).over(self.by_index(index).rangeBetween(-n, -n))


def growth_pct(v: Column, s: Series, periods: int = 1, points: bool = False) -> Column:
    if points:
        return percent_scale(v) - percent_scale(s.lag(v, periods))
    return pct_change(v, s.lag(v, periods))


def growth_abs(v: Column, s: Series, periods: int = 1, points: bool = False) -> Column:
    if points:
        return growth_pct(v, s, periods, True)
    return v - s.lag(v, periods)


def strict_growth(
    v: Column, s: Series, grain: str = "month", periods: int = 1, points: bool = False, absolute: bool = False
) -> Column:
    before = s.calendar(v, grain, periods)
    if points:
        return percent_scale(v) - percent_scale(before)
    return v - before if absolute else pct_change(v, before)


def acceleration(v: Column, s: Series, periods: int = 1, points: bool = False) -> Column:
    """Growth now less growth one row earlier."""
    one, base, base_one = s.lag(v, 1), s.lag(v, periods), s.lag(v, periods + 1)
    if points:
        v, one, base, base_one = map(percent_scale, (v, one, base, base_one))
        return (v - base) - (one - base_one)
    return pct_change(v, base) - pct_change(one, base_one)


def acceleration_abs(v: Column, s: Series, periods: int = 1, points: bool = False) -> Column:
    if points:
        return acceleration(v, s, periods, True)
    return (v - s.lag(v, periods)) - (s.lag(v, 1) - s.lag(v, periods + 1))


def mean_over(v: Column, frame) -> Column:
    """Mean over a frame in exact decimals, so that it does not depend on the order of additions."""
    return F.avg(v.cast("decimal(28,8)")).over(frame).cast("double")


def rolling_avg(v: Column, s: Series, months: int = 3, days: int | None = None) -> Column:
    """Mean over this month and the `months` calendar months before it."""
    if days is not None:
        months = max(1, round(days / 30))
    return mean_over(v, s.months(months))


def rolling_rows_avg(v: Column, s: Series, window: int = 3) -> Column:
    return mean_over(v, s.rows(window))


def std_dev(v: Column, s: Series, window: int = 3) -> Column:
    return F.stddev_samp(v).over(s.rows(window))


def vs_rolling_avg(v: Column, s: Series, window: int = 3) -> Column:
    return (F.try_divide(v, mean_over(v, s.rows(window))) - 1) * 100


def seasonality(v: Column, s: Series, window: int = 12) -> Column:
    return F.try_divide(v, mean_over(v, s.rows(window)))


def cumulative_sum(v: Column, s: Series) -> Column:
    """Running sum; a missing value stays missing instead of repeating the sum so far."""
    total = F.sum(v.cast("decimal(28,4)")).over(s.by_row.rowsBetween(W.unboundedPreceding, 0))
    return F.when(v.isNotNull(), total.cast("double"))


def rolling_z_score(v: Column, s: Series, window: int = 6) -> Column:
    frame = s.rows(window)
    spread = F.stddev_samp(v).over(frame)
    return F.when(F.count(v).over(frame) >= 2, F.try_divide(v - mean_over(v, frame), spread))


def benchmark_variance(v: Column, benchmark: Column | float | None, as_percentage: bool = True) -> Column:
    """Distance from a benchmark; NULL without one, and in percent also for a zero one."""
    base = benchmark if isinstance(benchmark, Column) else F.lit(benchmark).cast("double")
    return pct_change(v, base) if as_percentage else v - base


def pass_through(frame: DataFrame, source: str) -> Column:
    """A precomputed number read from a column; NULL when the frame has no such column."""
    if source not in frame.columns:
        return F.lit(None).cast("double")
    return finite(F.col(source).try_cast("double"))


SeriesFeature = Callable[..., Column]


@dataclass
class FeatureDef:
    """Registry entry: how a feature is computed and with which parameters."""

    name: str
    kind: str
    function: SeriesFeature | None = None
    params: dict[str, Any] = field(default_factory=dict)
    lookback: int = 0


FEATURES: dict[str, FeatureDef] = {}


def feature_key(name: str) -> str:
    return name.strip().removeprefix("calculate_")


def register_feature(
    name: str, function: SeriesFeature | None = None, kind: str = "series", lookback: int = 12, **params: Any
) -> FeatureDef:
    """Add or replace a feature. A series function gets `(value, series, **params)` and returns a Column."""
    entry = FeatureDef(feature_key(name), kind, function, params, lookback)
    FEATURES[entry.name] = entry
    return entry


def feature_def(name: str) -> FeatureDef:
    """Unknown names count as cross-section features without a function."""
    return FEATURES.get(feature_key(name), FeatureDef(feature_key(name), "cross"))


# Kind, default parameters and months of history of each named feature.
for _name in ("wow_growth_pct", "wom_growth_pct", "mom_growth_pct", "qoq_growth_pct", "yoy_growth_pct",
              "growth_pct", "growth_abs", "kpi_vs_rolling_avg_pct"):
    register_feature(_name, kind="snapshot", lookback=0)
for _name in ("acceleration", "acceleration_abs"):
    register_feature(_name, kind="acceleration", lookback=0)
register_feature("rolling_avg", rolling_avg, lookback=4, months=3)
register_feature("rolling_avg_6m", rolling_rows_avg, lookback=7, window=6)
register_feature("rolling_avg_12m", rolling_avg, lookback=13, days=365)
register_feature("std_dev", std_dev, lookback=7, window=6)
register_feature("std_dev_3m", std_dev, lookback=4, window=3)
register_feature("cumulative_sum", cumulative_sum, lookback=12)
for _name in ("rank", "rank_pct", "z_score", "sku_mix", "channel_mix", "region_mix",
              "benchmark_variance", "discount_depth", "self_kpi_value"):
    register_feature(_name, kind="cross", lookback=0)


def add_series_features(
    frame: DataFrame,
    features: dict[str, tuple[SeriesFeature, dict[str, Any]]] | Sequence[str],
    series: Series = Series(),
    value: str = "kpi_value",
    digits: int | None = 2,
) -> DataFrame:
    """Add one column per feature, all computed over the same sorted window."""
    if not isinstance(features, dict):
        defs = [feature_def(n) for n in features]
        features = {d.name: (d.function, d.params) for d in defs if d.function is not None}
    v = F.col(value)
    columns = {}
    for name, (function, params) in features.items():
        column = function(v, series, **params)
        columns[name] = column if digits is None else F.round(column, digits)
    return frame.withColumns(columns)


def add_strict_acceleration(frame: DataFrame, series: Series = Series(), *, grain: str = "month",
                            absolute: bool = False, points: bool = False, value: str = "kpi_value") -> DataFrame:
    """Difference of consecutive strict calendar growths, row by row."""
    grown = frame.withColumn("__g", strict_growth(F.col(value), series, grain, 1, points, absolute))
    return grown.withColumn("acceleration", F.round(F.col("__g") - series.lag(F.col("__g")), 2)).drop("__g")


def apply_python_feature(
    frame: DataFrame, name: str, function: Callable[[pd.DataFrame], pd.Series], keys: Sequence[str] = MEMBER
) -> DataFrame:
    """User-supplied pandas feature, run per member on Spark's grouped-map path.

    Only for logic that Columns cannot express; a group is one member's periods.
    """
    schema = StructType([*frame.schema.fields, StructField(name, DoubleType())])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("period_start").reset_index(drop=True)
        part[name] = function(part).astype("float64")
        return part

    return frame.groupBy(*keys).applyInPandas(run, schema)


def kpi_series(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    dims: Sequence[str],
    window: Window | None = None,
    filters: dict[str, Sequence[str]] | None = None,
    bucket: Callable[[Column], Column] = month_start,
) -> DataFrame:
    """KPI by member and period: `(kpi_name, dimension, dimension_value, period_start, kpi_value)`."""
    query = KpiQuery(star, tables, dims=tuple(d for d in dims if star.has_dimension(d)), window=window)
    for name, values in (filters or {}).items():
        query = query.member(name, tuple(values))
    wide = grouped_long(
        query.filtered(), star, dims,
        [Value(k, star.kpi(k).measure) for k in kpis],
        extra_keys=[bucket(F.col(star.date_column))],
    )
    rows = F.array(*[F.struct(F.lit(k).alias("kpi_name"), F.col(k).alias("kpi_value")) for k in kpis])
    return (
        wide.select("dimension", "dimension_value", F.col("__k0").alias("period_start"), F.inline(rows))
        .where("kpi_value is not null")
        .select("kpi_name", "dimension", "dimension_value", "period_start", "kpi_value")
    )


# --- cross-section features -------------------------------------------------------------------

# Values that a group may hold before its ranks are worked out in ranges, and ranges of a larger group
# (a square: the range of a value is found among the coarse splitters, then among the fine ones).
RANGE_VALUES = 8192
COARSE = 16
RANGES = COARSE * COARSE
SPLIT_ACCURACY = 10_000


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, test, how).drop(*[f"__r_{k}" for k in keys])


def add_period_stats(frame: DataFrame, within: Sequence[str] = PERIOD, value: str = "kpi_value") -> DataFrame:
    """z-score and mix against all members of the period.

    The per-period figures are small grouped aggregates joined back, so no task ever holds all
    members of a period.
    """
    v = F.col(value)
    stats = frame.groupBy(*within).agg(
        F.count(v).alias("__n"), F.stddev_samp(v).alias("__std"),
        F.sum(v.cast("decimal(28,8)")).cast("double").alias("__total"),
    )
    out = _null_safe(frame, stats, within)
    return out.withColumns({
        "z_score": F.round(F.try_divide(v - F.try_divide(F.col("__total"), F.col("__n")), F.col("__std")), 2),
        "mix": F.round(F.try_divide(v, F.col("__total")) * 100, 2),
    }).drop("__n", "__std", "__total")


def add_rank(
    frame: DataFrame,
    within: Sequence[str] = PERIOD,
    value: str = "kpi_value",
    ascending: bool = False,
    bounded: bool = False,
) -> DataFrame:
    """Minimum rank and `rank / count * 100` among the members of a period.

    NULL with fewer than two values. `bounded=True` is for groups known to be small and uses one
    window per group. Otherwise the rank is exact without bringing a group together: equal values
    are counted first, the values of a large group fall into ranges between its own quantiles, range
    totals give each range's offset, and only a range is sorted in one task.
    """
    v = F.col(value)
    if bounded:
        group = W.partitionBy(*within)
        order = v.asc_nulls_last() if ascending else v.desc_nulls_last()
        ranked = frame.withColumns({
            "__rank": F.when(v.isNotNull(), F.rank().over(group.orderBy(order))),
            "__n": F.count(v).over(group),
        })
    else:
        ranked = _ranged_rank(frame, list(within), value, ascending)
    enough = F.col("__n") >= 2
    return ranked.withColumns({
        "rank": F.when(enough, F.col("__rank").cast("double")),
        "rank_pct": F.round(F.when(enough, F.try_divide(F.col("__rank"), F.col("__n")) * 100), 2),
    }).drop("__rank", "__n")


def value_ranges(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`counts` (one row per group and value) with `__range`, which never decreases as the value grows.

    A group of at most RANGE_VALUES values is one range. A larger one is cut at its own quantiles, found
    by sketches that are merged across tasks, so its ranges hold about equally many values however
    unevenly these are spread. Only groups of thousands of values have splitters: a small table.
    """
    v = F.col(value)
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__values")).where(F.col("__values") > RANGE_VALUES)
    places = F.lit([i / RANGES for i in range(1, RANGES)])
    splitters = (
        _null_safe(counts, sizes, keys, "inner").groupBy(*keys)
        .agg(F.percentile_approx(v, places, F.lit(SPLIT_ACCURACY)).alias("__fine"))
        .withColumn("__coarse", F.filter("__fine", lambda _x, i: (i + 1) % COARSE == 0))
    )

    def below(cuts: Column | str) -> Column:
        return F.size(F.filter(cuts, lambda x: x < v))

    coarse = below("__coarse")
    number = coarse * COARSE + below(F.slice("__fine", coarse * COARSE + 1, F.lit(COARSE - 1)))
    return _null_safe(counts, splitters, keys).withColumn(
        "__range", F.when(F.col("__fine").isNull(), F.lit(0)).otherwise(number)).drop("__fine", "__coarse")


def _ranged_rank(frame: DataFrame, keys: list[str], value: str, ascending: bool) -> DataFrame:
    v = F.col(value)
    counts = frame.where(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__ties"))
    placed = value_ranges(counts, keys, value)
    sums = placed.groupBy(*keys, "__range").agg(F.sum("__ties").alias("__size"))
    # At most RANGES rows of a group meet here.
    group = W.partitionBy(*keys)
    before = group.orderBy(F.col("__range").asc() if ascending else F.col("__range").desc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
                          F.sum("__size").over(group).alias("__n"))
    located = _null_safe(placed, offsets, [*keys, "__range"], "inner")
    inside = (
        W.partitionBy(*keys, "__range").orderBy(v.asc() if ascending else v.desc())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    ranks = located.select(
        *keys, value, "__n",
        (F.col("__offset") + F.coalesce(F.sum("__ties").over(inside), F.lit(0)) + 1).alias("__rank"),
    )
    return _null_safe(frame, ranks, [*keys, value])
