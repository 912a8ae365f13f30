"""WHY: drill signals into other dimensions (route A) and dependent KPIs (route B)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..functions.numbers import breaches
from ..functions.periods import Window, window_from_text
from ..sources.config import Job, SignalDef, inline_rows, jobs_frame, signal_defs_frame
from .cube import cube_sets, day_cube, merged_values, set_name, slot_days
from .features import FEATURES, feature_def
from .model import SELF_NAMES, Star, Value, is_self
from .query import KpiQuery, dim_key, group_values, grouped_long, grouping_bits, job_filters, keep_members, kpis_long, shrinks
from .signals import stable_id
from .snapshot import Comparison, feature_value, filtered_star

ROUTE_A, ROUTE_B = "dimension", "dependency"
WHY_COLUMNS = (
    "why_id", "signal_id", "run_timestamp", "kpi_name", "dimension_name", "dimension_value", "signal_name",
    "dep_kpi_name", "dep_kpi_label", "rationale", "current_value", "prev_value", "change_pct", "period",
    "period_start", "period_end",
)


def explainable(signals: DataFrame, features: Sequence[str]) -> tuple[list[str], DataFrame]:
    """Growth-family features, and the signals of all others, which a drill cannot explain."""
    known = [f for f in features if feature_def(f).kind == "snapshot"]
    return known, signals.where(~F.col("feature_name").isin(known))


def explained_windows(signals: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Window each signal is explained over: its job's period, else the one stored with it, else one day.

    A stored window may be dates or only the recorded query text.
    """
    periods = jobs.select(
        "job_id", F.col("period_start").alias("__job_start"), F.col("period_end").alias("__job_end")
    ).dropDuplicates(["job_id"])
    start, end = window_from_text(F.col("kpi_query"))
    own = F.col("__job_start").isNotNull() & F.col("__job_end").isNotNull()
    return signals.join(periods, "job_id", "left").withColumns({
        "window_start": F.when(own, F.col("__job_start")).otherwise(F.coalesce(start, as_of)),
        "window_end": F.when(own, F.col("__job_end")).otherwise(F.coalesce(end, as_of)),
    }).drop("__job_start", "__job_end")


def drill_sets(signal_dims: Sequence[str], dims: Sequence[str]) -> list[tuple[str, ...]]:
    """Pairs of a signal dimension and another one, each once, and the signal dimensions alone for dependencies."""
    pairs = [(a, b) for i, a in enumerate(dims) for b in dims[i + 1:] if a in signal_dims or b in signal_dims]
    return [*pairs, *[(d,) for d in signal_dims]]


def drill_legs(sets: Sequence[tuple[str, ...]], signal_dims: Sequence[str], test: Callable[[tuple[str, ...]], Column]) -> Column:
    """The legs of a row of some set: signal member and drilled member, in both directions where both are signalled."""
    def leg(own: str, other: str | None) -> Column:
        return F.struct(
            F.lit(own).alias("dimension"),
            F.col(own).alias("dimension_value"),
            F.lit(other).cast("string").alias("drill_dimension"),
            (F.col(other) if other else F.lit(None).cast("string")).alias("drill_value"),
        )

    legs: Column | None = None
    for group in sets:
        directed = [leg(a, b) for a, b in (group, group[::-1]) if a in signal_dims] if len(group) == 2 \
            else [leg(group[0], None)]
        legs = F.when(test(group), F.array(*directed)) if legs is None else legs.when(test(group), F.array(*directed))
    return legs


def drill_values(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    signal_dims: Sequence[str],
    other_dims: Sequence[str],
    window: Window,
    features: Sequence[str],
    filters: Mapping[str, Sequence[str]] | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """Every leg of both routes from one scan.

    Grouping sets hold each pair (signal dimension, other dimension) once, and each signal
    dimension alone for the dependencies. A pair serves both directions. `members` narrows the
    scan to signalled members when a single, very wide signal dimension is drilled.
    """
    signal_dims = [d for d in dict.fromkeys(signal_dims) if not is_self(d)]
    real = list(dict.fromkeys([*signal_dims, *other_dims]))
    plan = Comparison(star, kpis, window, features)
    frame = filtered_star(star, tables, real, plan.windows, filters)
    if members is not None and len(signal_dims) == 1:
        frame = keep_members(frame, star.dimension(signal_dims[0]), members)
    sets = drill_sets(signal_dims, real)
    keys = {d: dim_key(star.dimension(d)).cast("string") for d in real}
    wide = group_values(frame, star, keys, sets, plan.values(), compact=shrinks(star, real))

    legs = drill_legs(sets, signal_dims, lambda group: F.col("__gid") == grouping_bits(real, group))
    return (
        wide.select(F.inline(legs), *[v.alias for v in plan.values()])
        .select("dimension", "dimension_value", "drill_dimension", "drill_value", plan.rows())
        .where("kpi_value is not null and feature_value is not null")
    )


def magnitude(change: Column, points: Column) -> Column:
    """`5.3%`, or `5.3 percentage points` for point KPIs."""
    number = F.round(F.abs(change).cast("decimal(18,2)"), 1).cast("string")
    return F.concat(number, F.when(points, " percentage points").otherwise("%"))


def rationale(subject: Column, member: Column, change: Column, points: Column) -> Column:
    moved = F.when(change > 0, " increased by ").otherwise(" decreased by ")
    return F.concat(subject, F.lit(" "), member, moved, magnitude(change, points))


def targets(spark: SparkSession, star: Star, kpis: Sequence[str]) -> DataFrame:
    """What to look up for a signal of each KPI: itself by other dimensions, and each dependency."""
    rows = [(k, k, ROUTE_A, star.kpi(k).points, star.dims_of(k)) for k in kpis]
    rows += [(k, dep, ROUTE_B, star.kpi(dep).points, ()) for k in kpis for dep in star.kpi(k).depends_on]
    return inline_rows(
        spark, rows, "parent_kpi string, target_kpi string, route string, points boolean, valid_dims array<string>"
    )


def with_upper_bound(signals: DataFrame, defs: DataFrame) -> DataFrame:
    """Upper bound of `between` signals, looked up from their definition when not stored."""
    bounds = defs.select(F.col("signal_name"), F.col("threshold2").alias("__upper"))
    base = signals if "threshold2" in signals.columns else signals.withColumn("threshold2", F.lit(None).cast("double"))
    return base.join(bounds, "signal_name", "left").withColumn(
        "threshold2", F.coalesce("threshold2", "__upper")
    ).drop("__upper")


def match(
    signals: DataFrame, drill: DataFrame, star: Star, kpis: Sequence[str], run_at: Column, also: Sequence[str] = (),
) -> DataFrame:
    """WHY rows of both routes from one join of signals with their drill values.

    Route A keeps other valid dimensions, route B the dependent KPIs on the signal's own member
    under the dependent KPI's own format; in both the signal's threshold must still fire. `also` names
    further columns that a signal and its values share.
    """
    own = F.col("d.drill_dimension").isNull()
    on = (
        (F.col("t.target_kpi") == F.col("d.kpi_name")) & (F.col("s.dimension") == F.col("d.dimension"))
        & (F.col("s.dimension_value") == F.col("d.dimension_value"))
        & (F.col("s.feature_name") == F.col("d.feature_name"))
    )
    for column in also:
        on = on & (F.col(f"s.{column}") == F.col(f"d.{column}"))
    fitting = F.when(F.col("t.route") == ROUTE_B, own).otherwise(
        ~own & F.col("d.drill_value").isNotNull() & F.array_contains("t.valid_dims", F.col("d.drill_dimension"))
    )
    still = breaches(F.col("s.operator"), F.col("d.feature_value"), F.col("s.threshold_value"), F.col("s.threshold2"))
    by_dependency = F.col("t.route") == ROUTE_B
    joined = (
        signals.alias("s").join(targets(signals.sparkSession, star, kpis).alias("t"),
                                F.col("s.kpi_name") == F.col("t.parent_kpi"))
        .join(drill.alias("d"), on).where(fitting & still)
    )
    dimension = F.coalesce("d.drill_dimension", "s.dimension")
    member = F.coalesce("d.drill_value", "s.dimension_value")
    subject = F.when(by_dependency, F.concat(F.lit("Dependent KPI "), F.col("t.target_kpi"))).otherwise(
        F.concat(F.lit("Cross-dimension "), F.col("d.drill_dimension"))
    )
    rows = joined.select(
        "s.signal_id", "s.kpi_name", dimension.alias("dimension_name"), member.alias("dimension_value"),
        "s.signal_name", F.when(by_dependency, F.col("t.target_kpi")).alias("dep_kpi_name"),
        F.when(by_dependency, F.concat("s.kpi_name", F.lit(" by "), "s.dimension")).alias("dep_kpi_label"),
        rationale(subject, member, F.col("d.feature_value"), F.col("t.points")).alias("rationale"),
        F.round("d.kpi_value", 2).alias("current_value"), F.round("d.prior_value", 2).alias("prev_value"),
        F.col("d.feature_value").alias("change_pct"), "s.period_start", "s.period_end",
    )
    return rows.withColumns({
        "why_id": stable_id(*[F.col(c) for c in ("signal_id", "dep_kpi_name", "dimension_name", "dimension_value")]),
        "run_timestamp": run_at,
        "period": F.concat(F.col("period_start").cast("string"), F.lit(" to "), F.col("period_end").cast("string")),
    }).select(*WHY_COLUMNS)


def explain(
    signals: DataFrame,
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    signal_dims: Sequence[str],
    window: Window,
    features: Sequence[str],
    run_at: Column,
    filters: Mapping[str, Sequence[str]] | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """WHY rows of both routes for the signals of one window and one set of filters.

    Signals on the whole portfolio have no dimension to drill and give no rows.
    """
    known = [f for f in dict.fromkeys(features) if feature_def(f).kind == "snapshot"]
    needed = list(dict.fromkeys([*kpis, *[d for k in kpis for d in star.kpi(k).depends_on]]))
    others = list(dict.fromkeys(d for k in kpis for d in star.dims_of(k)))
    drill = drill_values(star, tables, needed, signal_dims, others, window, known, filters, members)
    mine = signals.where(
        (F.col("period_start") == F.lit(window.start)) & (F.col("period_end") == F.lit(window.end))
    )
    return match(mine, drill, star, kpis, run_at)


def cube_drill(
    cube: DataFrame, star: Star, kpis: Sequence[str], signal_dims: Sequence[str], dims: Sequence[str], days: DataFrame,
    features: Sequence[str],
) -> DataFrame:
    """Every leg for every requested window, from the days of a cube joined to the days of the windows.

    `days` is `slot_days` of the windows. The number and mix of windows changes the data, not the plan.
    """
    sets = drill_sets(signal_dims, dims)
    names = [set_name(g) for g in sets]
    hits = {str(i): F.col("slot") == i for i in range(len(features) + 1)}
    keys = ["window_start", "window_end", "set", *dims]
    wide = merged_values(cube.where(F.col("set").isin(names)).join(days, "day"), star, kpis, keys, hits)
    rows = [
        F.struct(
            F.lit(k).alias("kpi_name"), F.lit(f).alias("feature_name"), F.col(f"{k}__0").alias("kpi_value"),
            F.col(f"{k}__{i}").alias("prior_value"),
            F.round(feature_value(star.kpi(k), f, F.col(f"{k}__0"), [F.col(f"{k}__{i}")]), 2).alias("feature_value"))
        for k in kpis for i, f in enumerate(features, start=1)
    ]
    legs = drill_legs(sets, signal_dims, lambda group: F.col("set") == set_name(group))
    values = [f"{k}__{n}" for k in kpis for n in hits]
    return (
        wide.select("window_start", "window_end", F.inline(legs), *values)
        .select("window_start", "window_end", "dimension", "dimension_value", "drill_dimension", "drill_value", F.inline(F.array(*rows)))
        .where("kpi_value is not null and feature_value is not null")
    )


def drillable(stars: Sequence[Star]) -> tuple[list[str], Column]:
    """Features that a drill explains, and the reason why a signal cannot be explained (NULL where it can)."""
    known = [name for name, one in FEATURES.items() if one.kind == "snapshot"]
    kpis = [k.name for star in stars for k in star.kpis]
    placed = F.lit(False)
    for star in stars:
        placed = placed | (F.col("kpi_name").isin([k.name for k in star.kpis]) & F.col("dimension").isin([d.name for d in star.dimensions]))
    reason = (
        F.when(~F.coalesce(F.col("feature_name").isin(known), F.lit(False)), "the feature cannot be drilled")
        .when(~F.coalesce(F.col("kpi_name").isin(kpis), F.lit(False)), "the KPI is in no star")
        .when(F.upper(F.trim("dimension")).isin(sorted(SELF_NAMES)), "the whole portfolio has no member to drill")
        .when(~F.coalesce(placed, F.lit(False)), "the dimension is not in the KPI's star")
    )
    return known, reason


def explain_signals(
    signals: DataFrame,
    stars: Sequence[Star],
    tables: Callable[[str], DataFrame],
    jobs: Sequence[Job],
    defs: Sequence[SignalDef],
    as_of: Column,
    run_at: Column,
) -> DataFrame:
    """WHY rows of signals of any windows, each explained over its own window.

    A signal's window is its job's period, else the stored one, else the day `as_of`; a missing upper bound
    comes from its definition. One plan for each star and each set of job filters serves every window:
    facts are added up by day, and the days meet the days of the requested windows in an equi-join.
    """
    spark = signals.sparkSession
    known, reason = drillable(stars)
    dated = with_upper_bound(explained_windows(signals, jobs_frame(spark, jobs), as_of), signal_defs_frame(spark, defs))
    able = dated.where(reason.isNull())
    out = None
    for star in stars:
        groups: dict[tuple, list[int]] = {}
        for job in jobs:
            if job.kpi_name in {k.name for k in star.kpis}:
                filters = job_filters(star, job.kpi_name, dict(job.filters))
                groups.setdefault(tuple(sorted((k, tuple(v)) for k, v in filters.items())), []).append(job.job_id)
        narrowed = [i for filters, ids in groups.items() if filters for i in ids]
        of_star = able.where(F.col("kpi_name").isin([k.name for k in star.kpis]))
        unfiltered = of_star.where(~F.coalesce(F.col("job_id").isin(narrowed), F.lit(False))) if narrowed else of_star
        for filters, mine in [((), unfiltered), *[(f, of_star.where(F.col("job_id").isin(ids))) for f, ids in groups.items() if f]]:
            part = _explain_star(mine, star, tables, known, dict(filters), run_at)
            if part is not None:
                out = part if out is None else out.unionByName(part)
    if out is None:
        return signals.where(F.lit(False)).select(*[F.lit(None).cast("string").alias(c) for c in WHY_COLUMNS])
    return out


def _explain_star(
    signals: DataFrame, star: Star, tables: Callable[[str], DataFrame], known: Sequence[str], filters: Mapping[str, Sequence[str]],
    run_at: Column,
) -> DataFrame | None:
    """Explain the signals of one star and one set of filters; None if there are none."""
    # Names of the catalogue, and the first and last day that any window needs: a few values, whatever the signals.
    used = signals.select("kpi_name", "dimension", "feature_name").distinct().collect()
    if not used:
        return None
    kpis = [k.name for k in star.kpis if any(r["kpi_name"] == k.name for r in used)]
    features = [f for f in known if any(r["feature_name"] == f for r in used)]
    signal_dims = [d.name for d in star.dimensions if any(r["dimension"] == d.name for r in used)]
    dims = list(dict.fromkeys([*signal_dims, *[d for k in kpis for d in star.dims_of(k)]]))
    needed = list(dict.fromkeys([*kpis, *[d for k in kpis for d in star.kpi(k).depends_on]]))
    days = slot_days(signals, features)
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if span["a"] is None:
        return None
    reach = Window(span["a"], span["b"])
    cube = day_cube(star, tables, needed, cube_sets((), drill_sets(signal_dims, dims)), reach.covers, filters)
    drill = cube_drill(cube, star, needed, signal_dims, dims, days, features)
    own = signals.withColumns({"period_start": F.col("window_start"), "period_end": F.col("window_end")})
    return match(own, drill, star, kpis, run_at, ("window_start", "window_end"))


def unexplained(signals: DataFrame, whys: DataFrame, stars: Sequence[Star] | None = None) -> DataFrame:
    """`signal_id, kpi_name, feature_name, reason` of the signals without a WHY row."""
    reason = drillable(stars)[1] if stars else F.lit(None).cast("string")
    rest = signals.join(whys.select("signal_id").distinct(), "signal_id", "left_anti")
    return rest.select("signal_id", "kpi_name", "feature_name",
                       F.coalesce(reason, F.lit("no other member or KPI passes the threshold")).alias("reason"))


def consolidated(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpi: str,
    signal_dim: str,
    window: Window,
    filters: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """All legs for one signal dimension as tagged rows: other dimensions, then dependencies."""
    deps = star.kpi(kpi).depends_on
    others = [d for d in star.dims_of(kpi) if d != signal_dim]
    query = KpiQuery(star, tables, dims=(signal_dim, *others), window=window)
    for name, values in (filters or {}).items():
        query = query.member(name, tuple(values))
    own = dim_key(star.dimension(signal_dim)).cast("string")
    wide = grouped_long(
        query.filtered(), star, [*others, "SELF"],
        [Value(k, star.kpi(k).measure) for k in (kpi, *deps)],
        extra_keys=[own],
    )
    def leg(tag: Column, member: Column, value: Column) -> Column:
        return F.struct(tag.alias("tag"), member.alias("dimension_value"), value.cast("double").alias("kpi_value"))

    # One pass over the aggregate: a row of another dimension is one leg, the own row one for each dependency.
    own_row = F.array(*[leg(F.lit(d), F.col("__k0"), F.col(d)) for d in deps])
    drilled = F.array(leg(F.col("dimension"), F.col("dimension_value"), F.col(kpi)))
    legs = F.when(F.col("dimension") != "SELF", drilled)
    return wide.select(F.col("__k0").alias("signal_dim_value"), F.inline(legs.otherwise(own_row) if deps else legs)).select(
        "tag", "signal_dim_value", "dimension_value", "kpi_value").where("kpi_value is not null")


def top_contributors(values: DataFrame, count: int = 3) -> DataFrame:
    """Per dimension, the lowest members below the dimension's mean.

    The mean is a small aggregate joined back and the row-number limit also runs before the
    shuffle, so no task receives all members of a dimension.
    """
    keys = ["kpi_name", "dimension"]
    mean = values.groupBy(*keys).agg(
        (F.sum(F.col("kpi_value").cast("decimal(28,8)")).cast("double") / F.count("kpi_value")).alias("mean_value")
    )
    below = values.join(mean, keys).where("kpi_value < mean_value")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.asc_nulls_last("kpi_value"), "dimension_value"))
    return below.withColumn("place", place).where(F.col("place") <= count)


def drill_down(
    star: Star, tables: Callable[[str], DataFrame], kpi: str, pinned: str, member: str, window: Window,
    filters: Mapping[str, Sequence[str]] | None = None, count: int = 3,
) -> DataFrame:
    """Lowest members below the mean of every other dimension, for one pinned member."""
    others = [d for d in star.dims_of(kpi) if d != pinned]
    values = kpis_long(star, tables, [kpi], others, window, {**(filters or {}), pinned: [member]})
    return top_contributors(values, count)


def dependency_values(
    star: Star, tables: Callable[[str], DataFrame], kpi: str, pinned: str, member: str, window: Window,
    filters: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Every dependency of a KPI for one pinned member."""
    return kpis_long(star, tables, star.kpi(kpi).depends_on, [pinned], window, {**(filters or {}), pinned: [member]})


def pending(signals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Signals whose id is not yet in the ledger of processed ids."""
    return signals.join(ledger.select("signal_id").distinct(), "signal_id", "left_anti")


def without(whys: DataFrame, ids: DataFrame) -> DataFrame:
    """WHY rows that remain when some signals are explained again."""
    return whys.join(ids.select("signal_id").distinct(), "signal_id", "left_anti")


def missing_ids(ids: DataFrame, signals: DataFrame) -> DataFrame:
    return ids.select("signal_id").distinct().join(signals.select("signal_id"), "signal_id", "left_anti")
