"""What the history of KPIs teaches: priors of KPI pairs from lagged regressions, and a timeline of anomalous weeks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.periods import week_start
from ..sources.stage import settled
from .cube import cube_series, cube_sets, day_cube, members_of, merged_values, of_sets, set_name
from .model import Star, is_self
from .signals import stable_id

LAGS = 4
HISTORY_WEEKS, LEAST_WEEKS = 26, 8
ANOMALOUS = 3.5
#: Fixed value: the spread of a normal distribution over its median absolute deviation.
MAD_TO_DEVIATION = 1.4826


def two_sided_p(t: Column, freedom: Column) -> Column:
    """Chance of a Student's t at least as far from 0, for whole degrees of freedom: the finite series of the distribution."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom.cast("double")))
    sine, cosine = F.sin(angle), F.cos(angle)
    odd = freedom % 2 == 1
    # Terms 1, c * cos^2, ... with c = (2k - 1) / 2k for even and 2k / (2k + 1) for odd degrees of freedom.
    steps = F.when(odd, F.floor((freedom - 3) / 2)).otherwise(F.floor((freedom - 2) / 2)).cast("int")
    shift = F.when(odd, F.lit(1)).otherwise(F.lit(0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * cosine * cosine * ((2 * k - 1 + shift) / (2 * k + shift))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.when(steps < 1, F.lit(1.0)).otherwise(
        F.aggregate(F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))), start, add, lambda s: s["sum"]))
    inner = F.when(odd, F.when(freedom == 1, angle).otherwise(angle + sine * cosine * series) * (2 / math.pi)).otherwise(sine * series)
    return F.greatest(F.lit(0.0), 1 - inner)


def weekly_levels(cube: DataFrame, star: Star, kpis: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """One row per dimension, member and week with a column for each KPI."""
    real = [d for d in dims if not is_self(d)]
    dated = of_sets(cube, cube_sets(dims)).withColumn("week", week_start(F.col("day")))
    wide = merged_values(dated, star, kpis, ["set", *real, "week"], {"0": None})
    return wide.select(*members_of(real), "week", *[F.col(f"{k}__0").alias(k) for k in kpis])


def lagged_moments(levels: DataFrame, kpis: Sequence[str], lags: int) -> DataFrame:
    """`target_kpi, regressor, lag, n, coef, r`: each KPI against each other one some weeks before, within members.

    A member's weeks are joined to its own earlier weeks by the calendar, so a gap is no neighbour. What is
    grouped are moments that merge, so the few groups take no rows together.
    """
    keys = ["dimension", "dimension_value", "week"]
    earlier = levels.select(
        F.col("dimension").alias("_d"), F.col("dimension_value").alias("_m"), F.col("week").alias("_w"),
        *[F.col(k).alias(f"_{k}") for k in kpis], F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"))
    same = (F.col("dimension") == F.col("_d")) & F.col("dimension_value").eqNullSafe(F.col("_m")) & (F.col("week") == F.date_add("_w", F.col("lag") * 7))
    rows = [F.struct(F.lit(y).alias("target_kpi"), F.lit(x).alias("regressor"), F.col(y).alias("y"), F.col(f"_{x}").alias("x"))
            for y in kpis for x in kpis if x != y]
    joined = levels.select(*keys, *kpis).join(earlier, same).select("lag", F.inline(F.array(*rows))).where("x is not null and y is not null")
    together, own, other = F.covar_pop("y", "x"), F.var_pop("y"), F.var_pop("x")
    # Without any spread both are NULL.
    return joined.groupBy("target_kpi", "regressor", "lag").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(together, other).alias("coef"), F.try_divide(together, F.sqrt(own * other)).alias("r"))


def fit_priors(
    cube: DataFrame, star: Star, kpis: Sequence[str], dims: Sequence[str], model_version: str, updated_at: Column, lags: int = LAGS,
    max_p_value: float = 0.10,
) -> DataFrame:
    """Correlation priors of one model version: for each KPI pair the lag of the smallest p-value (ties: the shorter).

    A pair with fewer than three weeks, or without any spread, has no prior. `is_active` is for p-values up
    to `max_p_value`; `replace_version` retires the rows of other versions.
    """
    # The levels are few rows that meet themselves: written once, the facts are read once.
    found = lagged_moments(settled(weekly_levels(cube, star, kpis, dims)), kpis, lags).where("n > 2 and r is not null")
    r, freedom = F.col("r"), (F.col("n") - 2)
    t = r * F.sqrt(freedom / F.greatest(1 - r * r, F.lit(1e-300)))
    tested = found.withColumn("p_value", F.round(two_sided_p(t, freedom), 6))
    best = tested.groupBy("target_kpi", "regressor").agg(F.min(F.struct("p_value", "lag", "coef", "n")).alias("b")).select("target_kpi", "regressor", "b.*")
    coef = F.when(F.abs("coef") >= 1, F.round("coef", 3)).otherwise(F.round("coef", 9))
    after = F.when(F.col("lag") == 0, "in the same week").when(F.col("lag") == 1, "a week later").otherwise(
        F.concat(F.col("lag").cast("string"), F.lit(" weeks later")))
    return best.select(
        stable_id(F.col("target_kpi"), F.col("regressor"), F.lit(model_version)).alias("prior_id"), "target_kpi", "regressor",
        coef.alias("coef"), "p_value", "lag", "n",
        F.concat("target_kpi", F.when(F.col("coef") > 0, " rises with ").otherwise(" falls with "), "regressor", F.lit(" "), after).alias("business_interpretation"),
        F.lit(model_version).alias("model_version"), (F.col("p_value") <= max_p_value).alias("is_active"), updated_at.alias("updated_at"))


def replace_version(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a new fit beside the earlier ones: equal keys are replaced, rows of other versions no longer count as active."""
    rest = stored.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    versions = fresh.select(F.col("model_version").alias("_v")).distinct()
    older = rest.join(versions, F.col("model_version") == F.col("_v"), "left").withColumn("is_active", F.col("is_active") & F.col("_v").isNotNull())
    return older.drop("_v").unionByName(fresh, allowMissingColumns=True)


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def against_history(series: DataFrame, keys: Sequence[str], weeks: int = HISTORY_WEEKS, least: int = LEAST_WEEKS) -> DataFrame:
    """`baseline` and `spread` of each week from the weeks before it: median, and median distance from it.

    A window holds one member's last `weeks` weeks by the calendar, never other members. Fewer than `least` values give NULL.
    """
    day = F.datediff("period_start", F.lit("1970-01-01").cast("date"))
    before = W.partitionBy(*keys).orderBy(day).rangeBetween(-7 * weeks, -1)
    held = F.collect_list("kpi_value").over(before)
    known = series.withColumn("_held", held).withColumn("baseline", F.when(F.size("_held") >= least, _median(F.col("_held"))))
    away = F.transform("_held", lambda v: F.abs(v - F.col("baseline")))
    return known.withColumn("spread", F.when(F.col("baseline").isNotNull(), _median(away) * MAD_TO_DEVIATION)).drop("_held")


def fit_anomalies(
    star: Star, tables: Callable[[str], DataFrame], kpis: Sequence[str], dims: Sequence[str], driver: str, model_version: str,
    updated_at: Column, limit: float = ANOMALOUS, weeks: int = HISTORY_WEEKS,
) -> DataFrame:
    """The anomaly timeline of some KPIs by some dimensions and in total, one row per member and week with a history.

    `anomaly_score` is the distance from the baseline in spreads; `anomaly_flag` is -1 beyond `limit`, else 1 (a
    member without any spread is anomalous where it leaves its baseline). `top_driver` is the member of `driver`
    that moved most against its own baseline within the same member and week (ties: the first by name).
    """
    real = [d for d in dims if not is_self(d)]
    pairs = [(d, driver) for d in real if d != driver]
    cube = day_cube(star, tables, kpis, cube_sets([*dims, driver], pairs))
    keys = ["kpi_name", "dimension", "dimension_value"]
    rated = against_history(cube_series(cube, star, kpis, dims, week_start), keys, weeks).where("baseline is not null")

    # The drivers' own weeks: members of `driver` inside each member, and alone for the total.
    dated = of_sets(cube, [*pairs, (driver,)]).withColumn("period_start", week_start(F.col("day")))
    wide = merged_values(dated, star, kpis, ["set", *dict.fromkeys([*real, driver]), "period_start"], {"0": None})
    own_name, own_member = F.when(F.col("set") == driver, F.lit("SELF")), F.when(F.col("set") == driver, F.lit("ALL"))
    for d, _ in pairs:
        own_name = own_name.when(F.col("set") == set_name((d, driver)), F.lit(d))
        own_member = own_member.when(F.col("set") == set_name((d, driver)), F.col(d))
    cells = wide.select(
        own_name.alias("dimension"), own_member.alias("dimension_value"), F.col(driver).alias("part"), "period_start",
        F.inline(F.array(*[F.struct(F.lit(k).alias("kpi_name"), F.col(f"{k}__0").alias("kpi_value")) for k in kpis]))).where("kpi_value is not null")
    moved = against_history(cells, [*keys, "part"], weeks, 1)
    # The largest move; of equal ones the first name.
    move = F.round(F.abs(F.col("kpi_value") - F.coalesce("baseline", F.lit(0.0))), 4)
    drivers = moved.where("part is not null").groupBy(*keys, "period_start").agg(F.min(F.struct((-move).alias("m"), "part")).alias("b")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("period_start").alias("_p"), F.concat(F.lit(f"{driver}="), "b.part").alias("top_driver"))
    same = F.col("period_start") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    away = F.col("kpi_value") - F.col("baseline")
    score = F.round(F.try_divide(away, F.col("spread")), 4)
    odd = F.coalesce(F.abs(score) > limit, away != 0)
    return rated.join(drivers, same, "left").select(
        stable_id(F.col("kpi_name"), F.col("period_start"), F.col("dimension"), F.col("dimension_value"), F.lit(model_version)).alias("anomaly_id"),
        "kpi_name", F.col("period_start").alias("week_start_date"), F.round("kpi_value", 4).alias("kpi_value"), score.alias("anomaly_score"),
        F.when(odd, -1).otherwise(1).alias("anomaly_flag"), "top_driver", F.col("dimension").alias("dimension_name"), "dimension_value",
        F.lit(model_version).alias("model_version"), F.lit(True).alias("is_active"), updated_at.alias("updated_at"))
