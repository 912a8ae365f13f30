"""Semantic star model: measures that take a predicate, dimensions, links and stars."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.periods import Window

SELF = "SELF"
SELF_MEMBER = "ALL"
# Names that mean "no dimension, the whole portfolio".
SELF_NAMES = frozenset({"SELF", "_SELF", "ALL", "(ALL)", "PORTFOLIO", "TOTAL"})


def is_self(name: str | None) -> bool:
    return (name or "").strip().upper() in SELF_NAMES


@dataclass(frozen=True)
class Part:
    """A piece of a measure that can be added up in steps: an exact sum, a row count or a key."""

    kind: str
    expr: str
    scale: int = 0

    def input(self, hit: Column | None) -> Column:
        """Value of one row, NULL where the row does not count."""
        if self.kind == "rows":
            condition = F.expr(self.expr)
            return F.when(condition if hit is None else hit & condition, F.lit(1))
        value = F.expr(self.expr)
        if self.kind == "total":
            value = value.cast(f"decimal(18,{self.scale})")
        return value if hit is None else F.when(hit, value)

    def whole(self, value: Column) -> Column:
        """Aggregate of row values in one step."""
        return {"total": F.sum, "rows": F.count, "distinct": F.count_distinct}[self.kind](value)

    @property
    def name(self) -> str:
        """Column name of the part in a table of parts: the same in every run."""
        return f"{self.kind}_{crc32(f'{self.expr}/{self.scale}'.encode()):08x}"

    def bucket(self) -> Column:
        """Which bitmap a row's key belongs to."""
        return F.bitmap_bucket_number(F.expr(self.expr).cast("bigint"))

    def mergeable(self, hit: Column | None = None) -> Column:
        """Aggregate of rows that can be merged further: a sum, a count, or a bitmap of the keys of one bucket."""
        if self.kind != "distinct":
            return (F.sum if self.kind == "total" else F.count)(self.input(hit))
        bit = F.bitmap_bit_position(F.expr(self.expr).cast("bigint"))
        return F.bitmap_construct_agg(bit if hit is None else F.when(hit, bit))

    def merged(self, value: Column) -> Column:
        """Mergeable values of the same bucket put together."""
        return F.bitmap_or_agg(value) if self.kind == "distinct" else F.sum(value)

    def closed(self, value: Column) -> Column:
        """The part itself from the values of all buckets."""
        return F.sum(F.bitmap_count(value)) if self.kind == "distinct" else F.sum(value)

    def word(self) -> Column:
        """Which word of 64 keys a row's key belongs to."""
        return F.shiftright(F.expr(self.expr).cast("bigint"), 6)

    def worded(self) -> Column:
        """`mergeable` with words in place of bitmaps: a number holds the keys of a word, so few keys take little room."""
        if self.kind != "distinct":
            return self.mergeable()
        bit = F.expr(self.expr).cast("bigint").bitwiseAND(F.lit(63)).cast("int")
        return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))

    def words_merged(self, value: Column) -> Column:
        """`worded` values of the same word put together."""
        return F.bit_or(value) if self.kind == "distinct" else F.sum(value)

    def words_closed(self, value: Column) -> Column:
        """The part itself from the values of all words."""
        return F.sum(F.bit_count(value)) if self.kind == "distinct" else F.sum(value)


class Measure:
    """An aggregate that can be restricted to the rows where a predicate holds.

    One scan can then give the same measure for several windows. A group without any matching
    row yields NULL, never zero.
    """

    def parts(self) -> tuple[Part, ...]:
        raise NotImplementedError

    def finish(self, got: Callable[[Part], Column]) -> Column:
        """The measure from its aggregated parts."""
        raise NotImplementedError

    def over(self, hit: Column | None = None) -> Column:
        """The measure as one aggregate expression."""
        return self.finish(lambda part: part.whole(part.input(hit)))


@dataclass(frozen=True)
class Total(Measure):
    """Exact sum. The decimal keeps the result independent of the order rows are added in."""

    expr: str
    scale: int = 2

    def parts(self) -> tuple[Part, ...]:
        return (Part("total", self.expr, self.scale),)

    def finish(self, got: Callable[[Part], Column]) -> Column:
        return got(self.parts()[0]).cast("double")


@dataclass(frozen=True)
class Rows(Measure):
    """Number of rows, optionally only those that satisfy a condition."""

    where: str = "true"

    def parts(self) -> tuple[Part, ...]:
        return (Part("rows", self.where),)

    def finish(self, got: Callable[[Part], Column]) -> Column:
        return F.nullif(got(self.parts()[0]), F.lit(0)).cast("double")


@dataclass(frozen=True)
class Distinct(Measure):
    """Exact number of distinct keys.

    Whole-number keys that are dealt out densely, as ids of a dimension are, are counted by bitmaps of
    32,768 keys each, which add up over days and groups. `bitmaps=False` is for any other keys.
    """

    key: str
    bitmaps: bool = True

    def parts(self) -> tuple[Part, ...]:
        return (Part("distinct", self.key, int(self.bitmaps)),)

    def finish(self, got: Callable[[Part], Column]) -> Column:
        return F.nullif(got(self.parts()[0]), F.lit(0)).cast("double")


@dataclass(frozen=True)
class Ratio(Measure):
    """Ratio of two measures over the same rows; zero when only the upper part is missing."""

    top: Measure
    bottom: Measure

    def parts(self) -> tuple[Part, ...]:
        return (*self.top.parts(), *self.bottom.parts())

    def finish(self, got: Callable[[Part], Column]) -> Column:
        return F.try_divide(F.coalesce(self.top.finish(got), F.lit(0.0)), self.bottom.finish(got))


@dataclass(frozen=True)
class Value:
    """A measure under a name, optionally for one window only."""

    alias: str
    measure: Measure
    window: Window | None = None

    def aggregate(self, day: Column) -> Column:
        return self.measure.over(None if self.window is None else self.window.covers(day)).alias(self.alias)


@dataclass(frozen=True)
class Dimension:
    """A grouping column. `via` names the links, in order, that bring the column to the fact."""

    name: str
    expr: str
    via: tuple[str, ...] = ()
    kind: str = "text"

    def column(self) -> Column:
        return F.expr(self.expr)


@dataclass(frozen=True)
class Link:
    """Equi-join from the star to one dimension table."""

    table: str
    left_key: str
    right_key: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Kpi:
    name: str
    measure: Measure
    format: str = "number"
    label: str = ""
    description: str = ""
    points: bool = False
    dimensions: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()

    @property
    def additive(self) -> bool:
        return isinstance(self.measure, (Total, Rows))


class CatalogueError(ValueError):
    """A KPI or dimension is unknown, or lacks the mapping a query needs."""


@dataclass(frozen=True)
class Star:
    """One fact table, its date column, the links to its dimensions, and its KPIs."""

    name: str
    fact: str
    date_column: str
    dimensions: tuple[Dimension, ...]
    kpis: tuple[Kpi, ...]
    links: dict[str, Link] = field(default_factory=dict)
    #: KPIs that give the values of features read from a column, such as `discount_depth`.
    sources: dict[str, str] = field(default_factory=dict)

    def kpi(self, name: str) -> Kpi:
        found = next((k for k in self.kpis if k.name.lower() == name.strip().lower()), None)
        if found is None:
            raise CatalogueError(f"KPI '{name}' is not in star '{self.name}'")
        return found

    def dimension(self, name: str) -> Dimension:
        found = next((d for d in self.dimensions if d.name.lower() == name.strip().lower()), None)
        if found is None:
            raise CatalogueError(f"Dimension '{name}' is not in star '{self.name}'")
        return found

    def has_dimension(self, name: str) -> bool:
        return any(d.name.lower() == name.strip().lower() for d in self.dimensions)

    def dims_of(self, kpi: str) -> tuple[str, ...]:
        return self.kpi(kpi).dimensions or tuple(d.name for d in self.dimensions if d.kind == "text")

    def scan(self, tables: Callable[[str], DataFrame], dims: Iterable[str] = ()) -> DataFrame:
        """The fact joined to just the tables that the named dimensions need.

        Left joins keep facts whose key has no match. No broadcast hint is given: Spark
        broadcasts a table below its own size threshold and shuffles beyond it.
        """
        frame = tables(self.fact)
        joined: set[str] = set()
        for name in dims:
            for step in self.dimension(name).via:
                if step in joined:
                    continue
                link = self.links[step]
                side = tables(link.table).select(link.right_key, *link.columns)
                on = F.col(link.left_key) == F.col(link.right_key)
                frame = frame.join(side, on, "left").drop(link.right_key)
                joined.add(step)
        return frame
