"""Day cubes: the parts of KPIs by day and members, which add up to any window without the facts.

A cube has one row for each day, set of dimensions, members and bucket of distinct keys. `set` names the
dimensions of the row (`segment`, `priority,segment`, or nothing for the total), their columns hold the
members as text and are NULL outside the set. The parts are exact sums, counts and the bits of 64 keys (a
bucket), as a member has few of all keys on one day: they merge over days, so a window is a sum of days and a
changed day is replaced alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import Window, any_window, prior_window_columns
from ..sources.stage import settled
from .model import SELF, SELF_MEMBER, Part, Star, is_self
from .query import KpiQuery, dim_key, for_sets, grouping_bits
from .snapshot import Comparison

MARK = "-"


def cube_parts(star: Star, kpis: Iterable[str]) -> list[Part]:
    """The distinct parts of some KPIs, in order."""
    return list(dict.fromkeys(p for k in kpis for p in star.kpi(k).measure.parts()))


def cube_sets(dims: Sequence[str], pairs: Sequence[tuple[str, str]] = ()) -> list[tuple[str, ...]]:
    """Sets of a cube: each dimension alone (SELF is the total) and some pairs."""
    return list(dict.fromkeys([*[() if is_self(d) else (d,) for d in dims], *pairs]))


def set_name(group: Sequence[str]) -> str:
    return ",".join(group)


def day_cube(
    star: Star,
    tables: Callable[[str], DataFrame],
    kpis: Sequence[str],
    sets: Sequence[Sequence[str]],
    rows: Callable[[Column], Column] | None = None,
    filters: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The cube of some KPIs from one scan; `rows` is a test of the date column that reaches the scan.

    Rows are added up by day and all members together before the shuffle, and only the combinations
    that occur are repeated for each set. Rows without a date belong to no day.
    """
    real = list(dict.fromkeys(d for s in sets for d in s))
    query = KpiQuery(star, tables, dims=tuple(real))
    for name, values in (filters or {}).items():
        query = query.member(name, tuple(values))
    dated = F.col(star.date_column)
    frame = query.filtered().where(dated.isNotNull())
    if rows is not None:
        frame = frame.where(rows(dated))
    parts = cube_parts(star, kpis)
    counted = {p.expr: p for p in parts if p.kind == "distinct"}
    if len(counted) > 1 or any(not p.scale for p in counted.values()):
        raise ValueError("a cube holds distinct counts of one whole-number key")
    bucket = next((p.word() for p in counted.values()), F.lit(0).cast("bigint"))
    keys = [dim_key(star.dimension(d)).cast("string").alias(d) for d in real]
    first = frame.groupBy(dated.cast("date").alias("day"), bucket.alias("bucket"), *keys).agg(*[p.worded().alias(p.name) for p in parts])
    # Each row is repeated for every set in one task, so the tasks stay as many as the session asks for, however well
    # the rows compress.
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["day", "bucket", *real]
    grouped = for_sets(first.repartition(tasks, "day", "bucket"), names, ["day", "bucket"], sets, [p.words_merged(F.col(p.name)).alias(p.name) for p in parts])
    label = F.create_map(*[F.lit(x) for s in sets for x in (grouping_bits(names, ["day", "bucket", *s]), set_name(s))])
    shown = grouped.withColumn("set", F.element_at(label, F.col("__gid").cast("int")))
    return shown.select("day", "set", "bucket", *real, *[p.name for p in parts])


def merged_values(cube: DataFrame, star: Star, kpis: Sequence[str], keys: Sequence[str], hits: Mapping[str, Column | None]) -> DataFrame:
    """KPIs of cube rows added up by `keys`: a column `<kpi>__<name>` for each KPI and each named test of the rows.

    Sums of days are taken before the shuffle. A group without any row that passes a test has NULL there.
    """
    parts = cube_parts(star, kpis)

    def held(part: Part, name: str) -> str:
        return f"{part.name}__{name}"

    def value(part: Part, hit: Column | None) -> Column:
        return F.col(part.name) if hit is None else F.when(hit, F.col(part.name))

    slots = [(p, n) for p in parts for n in hits]
    plain = [(p, n) for p, n in slots if p.kind != "distinct"]
    if len(plain) == len(slots):
        summed = cube.groupBy(*keys).agg(*[p.words_merged(value(p, hits[n])).alias(held(p, n)) for p, n in slots])
    else:
        by_bucket = cube.groupBy(*keys, "bucket").agg(*[p.words_merged(value(p, hits[n])).alias(held(p, n)) for p, n in slots])
        summed = by_bucket.groupBy(*keys).agg(*[p.words_closed(F.col(held(p, n))).alias(held(p, n)) for p, n in slots])
    finished = [star.kpi(k).measure.finish(lambda p, n=n: F.col(held(p, n))).alias(f"{k}__{n}") for k in kpis for n in hits]
    return summed.select(*keys, *finished)


def of_sets(cube: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of some sets; `set` is a column of the files, so the others are skipped where statistics allow."""
    return cube.where(F.col("set").isin([set_name(s) for s in sets]))


def members_of(dims: Sequence[str]) -> tuple[Column, Column]:
    """`dimension` and `dimension_value` of the rows of single dimensions and the total."""
    name, member = F.when(F.col("set") == "", F.lit(SELF)), F.when(F.col("set") == "", F.lit(SELF_MEMBER))
    for d in dims:
        name, member = name.when(F.col("set") == d, F.lit(d)), member.when(F.col("set") == d, F.col(d))
    return name.alias("dimension"), member.alias("dimension_value")


def cube_snapshot(
    cube: DataFrame, star: Star, kpis: Sequence[str], dims: Sequence[str], window: Window, features: Sequence[str],
    grain: str | None = None,
) -> DataFrame:
    """`snapshot` of a cube: current and earlier windows from its days, the facts are not read."""
    plan = Comparison(star, kpis, window, features, grain)
    day, real = F.col("day"), [d for d in dims if not is_self(d)]
    needed = of_sets(cube, cube_sets(dims)).where(any_window(day, plan.windows))
    wide = merged_values(needed, star, kpis, ["set", *real], {str(i): w.covers(day) for i, w in enumerate(plan.windows)})
    return wide.select(*members_of(real), plan.rows()).where("kpi_value is not null and feature_value is not null")


def cube_series(cube: DataFrame, star: Star, kpis: Sequence[str], dims: Sequence[str], bucket: Callable[[Column], Column]) -> DataFrame:
    """The series of each member by period; `bucket` gives the period of a day."""
    real = [d for d in dims if not is_self(d)]
    dated = of_sets(cube, cube_sets(dims)).withColumn("period_start", bucket(F.col("day")))
    wide = merged_values(dated, star, kpis, ["set", *real, "period_start"], {"0": None})
    rows = F.array(*[F.struct(F.lit(k).alias("kpi_name"), F.col(f"{k}__0").alias("kpi_value")) for k in kpis])
    return wide.select(*members_of(real), "period_start", F.inline(rows)).where("kpi_value is not null").select(
        "kpi_name", "dimension", "dimension_value", "period_start", "kpi_value")


def day_prints(star: Star, tables: Callable[[str], DataFrame]) -> DataFrame:
    """`day, n, print`: a fingerprint of each day's facts, whatever their order. Dimension tables are not read:
    members that change there ask for a new cube."""
    facts = tables(star.fact)
    hashed = F.xxhash64(*[F.col(c) for c in facts.columns]).cast("decimal(38,0)")
    return facts.where(F.col(star.date_column).isNotNull()).groupBy(F.col(star.date_column).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hashed).alias("print"))


def changed_days(now: DataFrame, before: DataFrame) -> DataFrame:
    """Days whose fingerprint is new, differs or is gone."""
    old = before.select("day", F.col("n").alias("_n"), F.col("print").alias("_print"))
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("print").eqNullSafe(F.col("_print"))
    return now.join(old, "day", "full").where(~same).select("day")


class StoredCube:
    """A cube in a folder, partitioned by month (or another `grain` of date truncation), with a fingerprint of the
    facts that each of its days was made from."""

    def __init__(self, spark: SparkSession, path: str, star: Star, kpis: Sequence[str], sets: Sequence[Sequence[str]],
                 grain: str = "month") -> None:
        self.spark, self.path, self.star, self.kpis, self.sets, self.grain = spark, path, star, list(kpis), [tuple(s) for s in sets], grain

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().where(F.col("set") != MARK)

    def fingerprints(self) -> DataFrame:
        return self._rows().where(F.col("set") == MARK).select("day", "n", "print")

    def create(self, tables: Callable[[str], DataFrame]) -> None:
        """Write the cube of all days anew."""
        self._write(self._fresh(tables, day_prints(self.star, tables), None), "static")

    def refresh(self, tables: Callable[[str], DataFrame], days: Sequence[date] | None = None) -> list[date]:
        """Bring the cube up to the facts; gives the days that were replaced.

        These are `days`, or without them the days whose fingerprint is new, differs or is gone. Only their
        facts are added up and only their partitions are written, with the other days' rows as they stand.
        Rows and fingerprints of a partition change together, so a refresh that broke off is made good by the next.
        """
        prints = day_prints(self.star, tables)
        if days is None:
            days = [r["day"] for r in changed_days(prints, self.fingerprints()).collect()]
        days = sorted(set(days))
        if days:
            wanted = self.spark.createDataFrame([(d,) for d in days], "day date")
            fresh = self._fresh(tables, wanted.join(prints, "day", "left"), [Window(d, d) for d in days])
            parts = wanted.select(F.trunc("day", self.grain).alias("part")).distinct()
            kept = self._rows().join(parts, "part", "left_semi").join(wanted, "day", "left_anti").drop("part")
            self._write(fresh.unionByName(settled(kept), allowMissingColumns=True), "dynamic")
        return days

    def _fresh(self, tables: Callable[[str], DataFrame], marks: DataFrame, runs: list[Window] | None) -> DataFrame:
        within = None if runs is None else lambda day: any_window(day, runs)
        cube = day_cube(self.star, tables, self.kpis, self.sets, within)
        return cube.unionByName(marks.withColumn("set", F.lit(MARK)), allowMissingColumns=True)

    def _write(self, rows: DataFrame, mode: str) -> None:
        # A large partition is split over tasks, small ones share a task.
        placed = rows.withColumn("part", F.trunc("day", self.grain)).hint("rebalance", "part").sortWithinPartitions("part", "set", "day")
        placed.write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", mode).parquet(self.path)


def slot_days(requests: DataFrame, features: Sequence[str]) -> DataFrame:
    """`window_start, window_end, slot, day`: the days of each requested window (slot 0) and of its earlier windows.

    Slot i + 1 is the window that feature i compares with. Windows are data: any mix of lengths makes one table.
    """
    start, end = F.col("window_start"), F.col("window_end")
    spans = [F.struct(F.lit(0).alias("slot"), start.alias("a"), end.alias("b"))]
    for i, feature in enumerate(features):
        a, b = prior_window_columns(F.lit(feature), start, end)
        spans.append(F.struct(F.lit(i + 1).alias("slot"), a.alias("a"), b.alias("b")))
    asked = requests.select("window_start", "window_end").where("window_start <= window_end").distinct()
    return asked.select("window_start", "window_end", F.inline(F.array(*spans))).where("a <= b").select(
        "window_start", "window_end", "slot", F.explode(F.sequence("a", "b")).alias("day"))

