"""KPI queries: measures by dimensions under date, member, exclusion and value filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import Window
from .model import SELF, SELF_MEMBER, CatalogueError, Dimension, Part, Star, Value, is_self

ISO_DAY = re.compile(r"^\s*(\d{4}-\d{2}-\d{2})([T ].*)?$")

HAVING: dict[str, Callable[[Column, float, float | None], Column]] = {
    "gt": lambda m, v, _: m > v,
    "lt": lambda m, v, _: m < v,
    "gte": lambda m, v, _: m >= v,
    "lte": lambda m, v, _: m <= v,
    "eq": lambda m, v, _: m == v,
    "ne": lambda m, v, _: m != v,
    "between": lambda m, v, v2: (m >= v) & (m <= v2),
}


def as_day(text: str) -> date | None:
    found = ISO_DAY.match(text)
    if not found:
        return None
    try:
        return date.fromisoformat(found.group(1))
    except ValueError:
        return None


def member_test(dimension: Dimension, values: Sequence[str]) -> Column:
    """Membership under the dimension's own type, for lists of any length; unreadable days match nothing.

    Days become range tests that reach the scan, one for each run of days that touch.
    """
    if dimension.kind == "date":
        days = sorted({d for d in map(as_day, map(str, values)) if d is not None})
        firsts = [d for i, d in enumerate(days) if i == 0 or d - days[i - 1] > timedelta(days=1)]
        lasts = [d for i, d in enumerate(days) if i + 1 == len(days) or days[i + 1] - d > timedelta(days=1)]
        tests = [Window(a, b).covers(dimension.column()) for a, b in zip(firsts, lasts, strict=True)] or [F.lit(False)]
        while len(tests) > 1:  # a flat tree, however many runs there are
            tests = [t[0] | t[1] if len(t) == 2 else t[0] for t in (tests[i : i + 2] for i in range(0, len(tests), 2))]
        return tests[0]
    return dimension.column().isin([str(v) for v in values])


@dataclass(frozen=True)
class Having:
    kpi: str
    operator: str
    value: float
    value2: float | None = None

    def __post_init__(self) -> None:
        if self.operator not in HAVING:
            raise ValueError(f"Unsupported operator: {self.operator!r}")
        if self.operator == "between" and self.value2 is None:
            raise ValueError("'between' needs an upper bound")

    def test(self, column: Column) -> Column:
        return HAVING[self.operator](column, self.value, self.value2)


@dataclass(frozen=True)
class KpiQuery:
    """Immutable builder: every call returns a new query, `to_df` gives the plan.

    Rows whose measures are all NULL are left out, which is what the source of such a query does.
    """

    star: Star
    tables: Callable[[str], DataFrame]
    measures: tuple[tuple[str, str], ...] = ()
    dims: tuple[str, ...] = ()
    window: Window | None = None
    members: tuple[tuple[str, tuple[str, ...]], ...] = ()
    excluded: tuple[tuple[str, tuple[str, ...]], ...] = ()
    havings: tuple[Having, ...] = ()

    def with_kpi(self, kpi: str, alias: str = "kpi_value") -> KpiQuery:
        self.star.kpi(kpi)
        return replace(self, measures=self.measures + ((kpi, alias),))

    def group_by(self, *dims: str) -> KpiQuery:
        kept = tuple(d for d in dims if not is_self(d))
        for name in kept:
            self.star.dimension(name)
        return replace(self, dims=self.dims + kept)

    def between(self, start: date, end: date) -> KpiQuery:
        return replace(self, window=Window(start, end))

    def member(self, dim: str, values: Iterable[str]) -> KpiQuery:
        self.star.dimension(dim)
        return replace(self, members=self.members + ((dim, tuple(values)),))

    def pin(self, dim: str, value: str) -> KpiQuery:
        return self.member(dim, (value,))

    def exclude(self, dim: str, values: Iterable[str]) -> KpiQuery:
        self.star.dimension(dim)
        return replace(self, excluded=self.excluded + ((dim, tuple(values)),))

    def having(self, operator: str, value: float, value2: float | None = None,
               kpi: str | None = None) -> KpiQuery:
        """Filter on a KPI's value; a KPI that is not selected is computed and then dropped."""
        if kpi is None and not self.measures:
            raise CatalogueError("having needs a measure")
        name = kpi or self.measures[0][0]
        self.star.kpi(name)
        return replace(self, havings=self.havings + (Having(name, operator, value, value2),))

    def filtered(self) -> DataFrame:
        """The star under every row filter, before aggregation."""
        needed = [*self.dims, *(d for d, _ in self.members), *(d for d, _ in self.excluded)]
        frame = self.star.scan(self.tables, needed)
        if self.window is not None:
            frame = frame.where(self.window.covers(F.col(self.star.date_column)))
        for name, values in self.members:
            frame = keep_members(frame, self.star.dimension(name), values)
        for name, values in self.excluded:
            dimension = self.star.dimension(name)
            frame = frame.where(dimension.column().isNull() | ~member_test(dimension, values))
        return frame

    def to_df(self) -> DataFrame:
        if not self.measures:
            raise CatalogueError("a KPI query needs at least one measure")
        shown = [self.star.kpi(k).measure.over().alias(a) for k, a in self.measures]
        hidden = [
            self.star.kpi(h.kpi).measure.over().alias(f"__having_{i}")
            for i, h in enumerate(self.havings)
        ]
        keys = [dim_key(self.star.dimension(d)).alias(d) for d in self.dims]
        out = self.filtered().groupBy(*keys).agg(*shown, *hidden)
        aliases = [a for _, a in self.measures]
        out = out.where(F.coalesce(*[F.col(a) for a in aliases]).isNotNull())
        for i, item in enumerate(self.havings):
            out = out.where(item.test(F.col(f"__having_{i}")))
        return out.select(*self.dims, *aliases)

    def ordered(self) -> DataFrame:
        return self.to_df().orderBy(*self.dims) if self.dims else self.to_df()


def dim_key(dimension: Dimension) -> Column:
    return dimension.column().cast("date") if dimension.kind == "date" else dimension.column()


def keep_members(frame: DataFrame, dimension: Dimension, values: Sequence[str] | DataFrame) -> DataFrame:
    """Keep the rows of some members: a test for a list, a semi join for members given as data."""
    if isinstance(values, DataFrame):
        wanted = values.select(F.col(values.columns[0]).alias("__member")).distinct()
        return frame.join(wanted, dim_key(dimension) == F.col("__member"), "left_semi")
    return frame.where(member_test(dimension, values))


def job_filters(star: Star, kpi: str, filters: dict[str, Sequence[str]]) -> dict[str, Sequence[str]]:
    """Only filters on the KPI's own dimensions count; other keys are passed over."""
    valid = {d.lower() for d in star.dims_of(kpi)}
    return {k: v for k, v in filters.items() if k.strip().lower() in valid}


def group_values(
    frame: DataFrame,
    star: Star,
    keys: Mapping[str, Column],
    sets: Sequence[Sequence[str]],
    values: Sequence[Value],
    always: Mapping[str, Column] | None = None,
    compact: bool = True,
) -> DataFrame:
    """Values for several sets of keys from one scan, with the set's `__gid`.

    With more than one set the rows are first added up by all keys together, which is done before
    the shuffle and leaves one row per combination that occurs; only these are repeated for each
    set. Sums and counts add up exactly, and a distinct count stays exact because the first step
    keeps a bitmap of its keys. `compact=False` is for keys with so many members that the first step
    would not shrink the data; then only the needed inputs are computed before rows are repeated.
    """
    always = dict(always or {})
    day = F.col(star.date_column)
    names = [*always, *keys]
    if len(sets) == 1:
        chosen = {**always, **{k: keys[k] for k in sets[0]}}
        one = frame.groupBy(*[c.alias(n) for n, c in chosen.items()]).agg(*[v.aggregate(day) for v in values])
        return one.withColumn("__gid", F.lit(grouping_bits(names, list(chosen))))

    slots: dict[tuple[Part, Window | None], str] = {}
    for v in values:
        for part in v.measure.parts():
            slots.setdefault((part, v.window), f"__p{len(slots)}")
    counted = {part for part, _ in slots if part.kind == "distinct"}
    compact = compact and len(counted) <= 1 and all(part.scale for part in counted)
    hits = {name: None if window is None else window.covers(day) for (_, window), name in slots.items()}
    named = [c.alias(n) for n, c in {**always, **keys}.items()]
    if not compact:
        flat = frame.select(*named, *[part.input(hits[n]).alias(n) for (part, _), n in slots.items()])
        grouped = for_sets(flat, names, list(always), sets, [part.whole(F.col(n)).alias(n) for (part, _), n in slots.items()])
    else:
        # A distinct count is a bitmap for each bucket of its keys; sums and counts are split by bucket with it.
        bucket = [part.bucket().alias("__bucket") for part in counted]
        flat = frame.groupBy(*bucket, *named).agg(*[part.mergeable(hits[n]).alias(n) for (part, _), n in slots.items()])
        extra = ["__bucket"] if counted else []
        grouped = for_sets(flat, [*extra, *names], [*extra, *always], sets, [part.merged(F.col(n)).alias(n) for (part, _), n in slots.items()])
        if counted:
            grouped = grouped.groupBy(*names, "__gid").agg(*[part.closed(F.col(n)).alias(n) for (part, _), n in slots.items()])
    finished = [
        v.measure.finish(lambda part, w=v.window: F.col(slots[part, w])).alias(v.alias) for v in values
    ]
    return grouped.select(*names, "__gid", *finished)


def for_sets(
    frame: DataFrame, names: Sequence[str], always: Sequence[str], sets: Sequence[Sequence[str]], values: Sequence[Column],
) -> DataFrame:
    """Aggregates for each set of keys; columns that every set has may stand first without changing `__gid`."""
    chosen = [[F.col(n) for n in [*always, *s]] for s in sets]
    return frame.groupingSets(chosen, *[F.col(n) for n in names]).agg(F.grouping_id().alias("__gid"), *values)


def shrinks(star: Star, dims: Sequence[str]) -> bool:
    """Categories have few members; day and key dimensions may have as many as there are rows."""
    return all(star.dimension(d).kind == "text" for d in dims)


def grouped_long(
    frame: DataFrame,
    star: Star,
    dims: Sequence[str],
    values: Sequence[Value],
    extra_keys: Sequence[Column] = (),
) -> DataFrame:
    """Values by several dimensions at once: extra keys `__k0..`, `dimension`, `dimension_value`, values.

    `SELF` stands for the total. Members are text so that dimensions of different types can share
    a column.
    """
    real = list(dict.fromkeys(d for d in dims if not is_self(d)))
    sets = [[d] for d in real] + ([[]] if any(is_self(d) for d in dims) else [])
    keys = {d: dim_key(star.dimension(d)).cast("string") for d in real}
    always = {f"__k{i}": c for i, c in enumerate(extra_keys)}
    grouped = group_values(frame, star, keys, sets, values, always, shrinks(star, real))
    label: Column | None = None
    member: Column | None = None
    for group in sets:
        test = F.col("__gid") == grouping_bits([*always, *real], [*always, *group])
        name = group[0] if group else SELF
        value = F.col(name) if group else F.lit(SELF_MEMBER)
        label = F.when(test, F.lit(name)) if label is None else label.when(test, F.lit(name))
        member = F.when(test, value) if member is None else member.when(test, value)
    if len(sets) == 1:
        label = F.lit(sets[0][0] if sets[0] else SELF)
        member = F.col(sets[0][0]) if sets[0] else F.lit(SELF_MEMBER)
    return grouped.select(
        *always, label.alias("dimension"), member.alias("dimension_value"), *[F.col(v.alias) for v in values]
    )


def grouping_bits(columns: Sequence[str], group: Sequence[str]) -> int:
    """`grouping_id` of a set when the columns were listed in this order."""
    bits = 0
    for name in columns:
        bits = bits * 2 + (0 if name in group else 1)
    return bits


def kpis_long(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    dims: Sequence[str],
    window: Window | None = None,
    filters: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Every KPI by every dimension from one scan: `(kpi_name, dimension, dimension_value, kpi_value)`."""
    query = KpiQuery(star, tables, dims=tuple(d for d in dims if not is_self(d)), window=window)
    for name, values in (filters or {}).items():
        query = query.member(name, tuple(values))
    wide = grouped_long(
        query.filtered(), star, dims, [Value(k, star.kpi(k).measure) for k in kpis]
    )
    pairs = [(k, d) for k in kpis for d in dims]
    valid = {
        k: [d for d in dims if is_self(d) or d in star.dims_of(k)] for k in kpis
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kpi_name"), F.col(k).alias("kpi_value")) for k in kpis])
    out = wide.select("dimension", "dimension_value", F.inline(rows)).where("kpi_value is not null")
    if any(d not in valid[k] for k, d in pairs):
        keep = F.lit(False)
        for k in kpis:
            names = [SELF if is_self(d) else d for d in valid[k]]
            keep = keep | ((F.col("kpi_name") == k) & F.col("dimension").isin(names))
        out = out.where(keep)
    return out.select("kpi_name", "dimension", "dimension_value", "kpi_value")
