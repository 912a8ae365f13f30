"""Insight clusters and payloads.

A cluster can hold any number of signals and WHY rows. Membership is therefore kept as a long
table, sizes come from grouped sums, and only clusters whose text passes the size gate are ever
packed into one row. Label lists use a row-number limit, which Spark also applies before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.display import metric_text, plain_number, stored_number
from ..functions.numbers import direction
from ..functions.periods import period_label
from .signals import stable_id

# Longest WHY text of a cluster, and the smallest limit that may be configured.
TEXT_LIMIT = 200_000
LOWEST_TEXT_LIMIT = 1024
# What stored texts hold at most; operators keep everything unless a caller passes these.
MEMBER_CHARS = 4000
DRIVER_ITEMS = 120
DRIVER_CHARS = 2000
KPI_ITEMS, KPI_CHARS = 700, 2000
CANONICAL_CHARS = 400
SUMMARY_LABELS = 16
PLACEHOLDERS = ("", "NA", "N/A", "NULL")
PORTFOLIO_LABEL = "KPI Portfolio"


def text_limit(configured: int | None = None) -> int:
    return TEXT_LIMIT if configured is None else max(LOWEST_TEXT_LIMIT, configured)


def clean(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def dedupe_whys(whys: DataFrame) -> DataFrame:
    """One row per WHY id; rows without an id by signal, driver, slice and change."""
    natural = F.concat_ws("|", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
        ("signal_id", "dep_kpi_name", "dep_kpi_label", "dimension_name", "dimension_value", "change_pct")
    ])
    key = F.when(clean("why_id") != "", F.col("why_id")).otherwise(natural)
    return whys.withColumn("__key", key).dropDuplicates(["__key"]).drop("__key")


def driver_first(whys: DataFrame) -> DataFrame:
    """Driver, label, slice and signal order, ignoring case."""
    return whys.orderBy(*[F.lower(clean(c)) for c in
                          ("dep_kpi_name", "dep_kpi_label", "dimension_name", "dimension_value")], "signal_id")


def or_dash(name: str) -> Column:
    return F.when(clean(name) != "", clean(name)).otherwise("—")


def driver_label() -> Column:
    """Metric a WHY row is about: its driver, else the main KPI."""
    return F.coalesce(*[F.when(clean(c) != "", clean(c)) for c in ("dep_kpi_label", "dep_kpi_name", "kpi_name")],
                      F.lit(""))


def why_line() -> Column:
    """A WHY row as one labelled line."""
    return F.concat(
        F.lit("WHY | main_metric="), F.col("kpi_name"), F.lit(" | signal_id="), F.col("signal_id"),
        F.lit(" | driver_metric "), or_dash("dep_kpi_label"),
        F.lit(" (dependent_driver_id="), or_dash("dep_kpi_name"),
        F.lit(") | driver_slice "), clean("dimension_name"), F.lit(" — "), clean("dimension_value"),
        F.lit(" | change_pct="), stored_number(F.col("change_pct")), F.lit("%"),
        F.lit(" | current="), metric_text(driver_label(), F.col("current_value")),
        F.lit(" | prev="), metric_text(driver_label(), F.col("prev_value")),
        F.lit(" | Rationale: "), F.coalesce(F.col("rationale"), F.lit("")),
    )


def one_line(value: Column) -> Column:
    """Text made safe for a pipe-separated row."""
    return F.trim(F.translate(F.coalesce(value, F.lit("")), "|\r\n", "/  "))


def why_payload_line() -> Column:
    driver = F.coalesce(F.when(clean("dep_kpi_label") != "", clean("dep_kpi_label")),
                        F.when(clean("dep_kpi_name") != "", clean("dep_kpi_name")), F.lit("n/a"))
    return F.concat_ws(
        " | ",
        F.when(clean("why_id") != "", clean("why_id")).otherwise("n/a"), F.col("signal_id"), driver,
        F.when(F.col("dimension_name") != "", F.col("dimension_name")).otherwise("n/a"),
        F.when(F.col("dimension_value") != "", F.col("dimension_value")).otherwise("n/a"),
        F.when(clean("dep_kpi_name") != "", clean("dep_kpi_name")).otherwise("null"),
        metric_text(driver_label(), F.col("current_value")), metric_text(driver_label(), F.col("prev_value")),
        stored_number(F.col("change_pct"), "n/a"), one_line(F.col("rationale")),
    )


def signal_payload_line(window: Column) -> Column:
    label = F.coalesce(F.when(clean("feature_name") != "", clean("feature_name")),
                       F.when(clean("signal_name") != "", clean("signal_name")), F.lit("unnamed_feature"))
    return F.concat_ws(
        " | ", F.col("signal_id"), F.coalesce(F.col("kpi_name"), F.lit("n/a")), label,
        metric_text(F.col("kpi_name"), F.col("current_kpi_value")),
        metric_text(F.col("kpi_name"), F.col("prev_kpi_value")),
        plain_number(F.col("feature_value")), window,
        direction(F.col("current_kpi_value"), F.col("prev_kpi_value")),
    )


def window_pair(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit(" to "), end.cast("string"))


def windows_of(whys: DataFrame, keys: Sequence[str], shown: int = 3) -> DataFrame:
    """Distinct windows per key: count, first start, last end, and `a to b`, `mixed: ...` text."""
    known = whys.where("period_start is not null and period_end is not null")
    spans = known.select(*keys, "period_start", "period_end").distinct()
    totals = spans.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_count"), F.min("period_start").alias("first_start"),
        F.max("period_end").alias("last_end"),
    )
    place = F.row_number().over(W.partitionBy(*keys).orderBy("period_start", "period_end"))
    firsts = (
        spans.withColumn("__p", place).where(F.col("__p") <= shown).groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("__p", window_pair(F.col("period_start"), F.col("period_end")).alias("w")))),
            lambda s: s["w"]), "; ").alias("__text"))
    )
    more = F.col("window_count") - shown
    text = (
        F.when(F.col("window_count") == 1, F.col("__text"))
        .otherwise(F.concat(F.lit("mixed: "), F.col("__text"),
                            F.when(more > 0, F.concat(F.lit("; +"), more.cast("string"), F.lit(" more"))).otherwise("")))
    )
    return totals.join(firsts, list(keys)).withColumn("windows", text).drop("__text")


def signal_payload(signals: DataFrame, whys: DataFrame) -> DataFrame:
    """One payload line per signal with its windows."""
    spans = windows_of(whys, ["signal_id"]).select("signal_id", "windows")
    joined = signals.join(spans, "signal_id", "left")
    return joined.select("signal_id", "kpi_name", "dimension",
                         signal_payload_line(F.coalesce("windows", F.lit("n/a"))).alias("line"))


def why_payload(whys: DataFrame) -> DataFrame:
    return whys.select("why_id", "signal_id", "kpi_name", why_payload_line().alias("line"))


def first_labels(rows: DataFrame, keys: Sequence[str], label: str, count: int | None, out: str, ignore_case: bool = False) -> DataFrame:
    """The distinct labels of each key in order, or the first `count`, as an array, with the total count."""
    distinct = rows.where(F.col(label) != "").select(*keys, label).distinct()
    order = [F.lower(label), F.col(label)] if ignore_case else [F.col(label)]
    total = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{out}_count"))
    if count is None:
        def plain(label_: Column) -> Column:
            return F.transform(F.array_sort(label_), lambda s: s["__l"])

        each = F.struct(*([F.lower(label).alias("__o")] if ignore_case else []), F.col(label).alias("__l"))
        return distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{out}_count"), plain(F.collect_list(each)).alias(out))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    firsts = (
        distinct.withColumn("__p", place).where(F.col("__p") <= count).groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", F.col(label).alias("__l")))),
                         lambda s: s["__l"]).alias(out))
    )
    return total.join(firsts, list(keys))


def joined_members(signals: DataFrame, keys: Sequence[str], chars: int | None = None) -> DataFrame:
    """Distinct members, sorted and joined, with their number; the text may be cut to `chars`.

    A member takes at least three characters with its separator, so of a cut text more than a third
    of the length can never show.
    """
    rows = signals.select(*keys, clean("dimension_value").alias("__m"))
    joined = F.array_join("__members", ", ")
    return first_labels(rows, keys, "__m", None if chars is None else chars // 3 + 2, "__members").select(
        *keys, F.col("__members_count").alias("member_count"),
        (joined if chars is None else F.left(joined, F.lit(chars))).alias("dimension_value"),
    )


def driver_line(whys: DataFrame, keys: Sequence[str], items: int | None = None, chars: int | None = None) -> DataFrame:
    """Distinct drivers of each cluster as one line, with their number; the line may be cut to `items` and `chars`."""
    name, label = clean("dep_kpi_name"), clean("dep_kpi_label")
    shown = (
        F.when((name != "") & (label != "") & (name != label), F.concat(label, F.lit(" (id="), name, F.lit(")")))
        .when(label != "", label).otherwise(name)
    )
    listed = first_labels(whys.select(*keys, shown.alias("__driver")), keys, "__driver", items, "__drivers")
    joined = F.array_join("__drivers", ", ")
    return listed.select(
        *keys, F.col("__drivers_count").alias("driver_count"),
        (joined if chars is None else F.when(F.length(joined) > chars, F.concat(F.left(joined, F.lit(chars - 1)), F.lit("…")))
         .otherwise(joined)).alias("drivers"),
    )


def text_sizes(lines: DataFrame, keys: Sequence[str], line: str = "line") -> DataFrame:
    """Length of each cluster's joined text, from sums: nothing is joined to find it out."""
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("why_count"),
        (F.sum(F.length(line)) + F.count(F.lit(1)) - 1).alias("why_chars"),
    )


def joined_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct signal ids of each key as one text, whatever its length: a view for readers of a few clusters.

    Membership itself is the long table of `cluster_signals`.
    """
    return rows.select(*keys, "signal_id").distinct().groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("signal_id")), ",").alias("signal_ids")
    )


def cluster_lines(signals: DataFrame, whys: DataFrame) -> DataFrame:
    """WHY rows with the KPI and dimension of the signal they belong to, and their text line."""
    owner = signals.select("signal_id", F.col("kpi_name").alias("cluster_kpi"), F.col("dimension").alias("cluster_dim")).distinct()
    return dedupe_whys(whys).join(owner, "signal_id").withColumn("line", why_line())


def standard_clusters(
    signals: DataFrame, whys: DataFrame, limit: int | None = None, ids: bool = False, member_chars: int | None = None,
) -> DataFrame:
    """One cluster per KPI and dimension; `kept` tells whether its WHY text passes the size gate.

    `ids` adds the joined signal ids, see `joined_ids`; `member_chars` cuts the text of members, not their number.
    """
    most = text_limit(limit)
    keys = ["kpi_name", "dimension"]
    lines = cluster_lines(signals, whys).select(
        F.col("cluster_kpi").alias("kpi_name"), F.col("cluster_dim").alias("dimension"), "line"
    )
    sizes = text_sizes(lines, keys)
    counts = signals.groupBy(*keys).agg(F.count_distinct("signal_id").alias("signal_count"))
    chars = F.coalesce("why_chars", F.lit(0))
    if ids:
        counts = counts.join(joined_ids(signals, keys), keys)
    return (
        counts.join(joined_members(signals, keys, member_chars), keys, "left").join(sizes, keys, "left")
        .select(
            stable_id(F.lit("standard"), F.col("kpi_name"), F.col("dimension")).alias("cluster_id"),
            F.lit("alpha").alias("cluster_type"), "kpi_name", F.col("dimension").alias("dimension_name"),
            F.coalesce("dimension_value", F.lit("")).alias("dimension_value"),
            F.lit("Mixed").alias("period"), "signal_count", *(["signal_ids"] if ids else []),
            F.coalesce("why_count", F.lit(0)).alias("why_count"), chars.alias("why_chars"),
            (chars <= most).alias("kept"),
        )
    )


def skip_report(clusters: DataFrame, limit: int | None = None) -> DataFrame:
    """Skipped clusters with the reason."""
    most = text_limit(limit)
    return clusters.where("not kept").select(
        "cluster_id", "kpi_name", "dimension_name", "why_chars",
        F.concat(F.lit("standard: "), F.col("kpi_name"), F.lit(" / "), F.col("dimension_name"),
                 F.lit(" (why_text "), F.col("why_chars").cast("string"), F.lit(f" chars > {most}; skipped)")).alias("reason"),
    )


def canonical_member(bucket: Column, values: Column, chars: int | None = None) -> Column:
    """A single real member wins; then the bucket's own; then all real members joined."""
    own, joined = F.trim(F.coalesce(bucket, F.lit(""))), F.array_join(F.array_sort(values), ", ")
    return (
        F.when(F.size(values) == 1, F.element_at(values, 1))
        .when(~F.upper(own).isin(*PLACEHOLDERS), own)
        .when(F.size(values) > 1, joined if chars is None else F.left(joined, F.lit(chars)))
        .otherwise(own)
    )


BUCKET = ["dimension_name", "dimension_value", "period_start", "period_end"]


def bucket_rows(signals: DataFrame, whys: DataFrame, dims: Sequence[str], batch: Column | None = None) -> DataFrame:
    """WHY rows with their signal's slice as bucket key, for allowed dimensions (ignoring case)."""
    allowed = [d.strip().lower() for d in dims if d.strip()]
    chosen = signals.where(F.lower(F.trim("dimension")).isin(allowed))
    if batch is not None:
        chosen = chosen.where(F.col("detected_at") == batch)
    slices = chosen.select(
        "signal_id", F.trim("dimension").alias("slice_dim"), F.trim("dimension_value").alias("slice_value"),
        F.col("kpi_name").alias("signal_kpi"),
    ).distinct()
    known = whys.where("period_start is not null and period_end is not null").withColumn("line", why_line())
    return known.join(slices, "signal_id")


def dimensional_clusters(
    signals: DataFrame, whys: DataFrame, dims: Sequence[str], limit: int | None = None, batch: Column | None = None,
    ids: bool = False, kpi_items: int | None = None, kpi_chars: int | None = None,
) -> DataFrame:
    """One cluster per slice and window; `ids` adds the joined signal ids, see `joined_ids`.

    `kpi_items` and `kpi_chars` cut the text of KPI names.
    """
    most = text_limit(limit)
    # A line counts by its length and its hash, so its text is in no shuffle.
    rows = bucket_rows(signals, whys, dims, batch).select(
        F.col("slice_dim").alias("dimension_name"), F.col("slice_value").alias("dimension_value"), "period_start", "period_end",
        "signal_id", "signal_kpi", "why_id", F.xxhash64("line").alias("__hash"), F.length("line").alias("__chars"),
    ).distinct()
    # A bucket's KPI names come from the catalogue, so their set is small.
    found = rows.groupBy(*BUCKET).agg(
        F.count_distinct("signal_id").alias("signal_count"), F.count(F.lit(1)).alias("why_count"),
        (F.sum("__chars") + F.count(F.lit(1)) - 1).alias("why_chars"), F.array_sort(F.collect_set("signal_kpi")).alias("kpis"),
    )
    if ids:
        found = found.join(joined_ids(rows, BUCKET), BUCKET)
    names = F.array_join("kpis" if kpi_items is None else F.slice("kpis", 1, kpi_items), ", ")
    if kpi_chars is not None:
        names = F.left(names, F.lit(kpi_chars))
    return found.select(
        stable_id(F.lit("dimensional"), *[F.col(c) for c in BUCKET]).alias("cluster_id"),
        F.lit("dimensional").alias("cluster_type"), F.when(F.size("kpis") > 0, names).otherwise("—").alias("kpi_name"),
        "dimension_name", "dimension_value",
        period_label(F.col("period_start"), F.col("period_end")).alias("period"),
        "period_start", "period_end", "signal_count", *(["signal_ids"] if ids else []), "why_count", "why_chars",
        (F.col("why_chars") <= most).alias("kept"),
    )


def cluster_signals(signals: DataFrame, whys: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Membership of every cluster of each type, one row per cluster and signal, without any limit."""
    standard = signals.select(
        stable_id(F.lit("standard"), F.col("kpi_name"), F.col("dimension")).alias("cluster_id"), F.lit("alpha").alias("cluster_type"), "signal_id")
    dimensional = bucket_rows(signals, whys, dims).select(
        stable_id(F.lit("dimensional"), F.col("slice_dim"), F.col("slice_value"), F.col("period_start"), F.col("period_end")).alias("cluster_id"),
        F.lit("dimensional").alias("cluster_type"), "signal_id")
    rollup = signals.where(clean("kpi_name") != "").select(
        stable_id(F.lit("rollup"), F.lower(F.trim("kpi_name"))).alias("cluster_id"), F.lit("rollup").alias("cluster_type"), "signal_id")
    return standard.unionByName(dimensional).unionByName(rollup).distinct()


SIGNAL_FIELDS = ("signal_id", "kpi_name", "dimension", "dimension_value", "observed_value", "threshold_value",
                 "breach_delta", "signal_name", "feature_name", "feature_value", "current_kpi_value", "prev_kpi_value")
WHY_FIELDS = ("signal_id", "kpi_name", "dimension_name", "dimension_value", "signal_name", "dep_kpi_name",
              "current_value", "prev_value", "change_pct", "period")


def bucket_json(signals: DataFrame, whys: DataFrame, dims: Sequence[str], limit: int | None = None) -> DataFrame:
    """Kept buckets with their signals and WHY rows as JSON arrays. The gate bounds every array."""
    header = dimensional_clusters(signals, whys, dims, limit).where("kept")
    allowed = header.select("cluster_id", *BUCKET)
    rows = bucket_rows(signals, whys, dims)
    keyed = rows.select(
        F.col("slice_dim").alias("dimension_name"), F.col("slice_value").alias("dimension_value"),
        "period_start", "period_end", "signal_id",
        F.struct("why_id", F.struct(*[F.col(c) for c in WHY_FIELDS]).alias("row")).alias("__w"),
    ).withColumnRenamed("signal_id", "__sid")
    inside = keyed.join(allowed, BUCKET)
    why_json = inside.groupBy("cluster_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_set("__w")), lambda w: w["row"])).alias("why_json")
    )
    one = signals.select(F.col("signal_id").alias("__sid"), F.struct(*SIGNAL_FIELDS).alias("__s"))
    signal_json = inside.select("cluster_id", "__sid").distinct().join(one, "__sid").groupBy("cluster_id").agg(
        F.to_json(F.array_sort(F.collect_set("__s"))).alias("signals_json")
    )
    return header.join(why_json, "cluster_id").join(signal_json, "cluster_id")


def slice_label() -> Column:
    dim, member = clean("dimension"), clean("dimension_value")
    return F.when((dim != "") & (member != ""), F.concat(dim, F.lit(" — "), member)).otherwise(F.concat(dim, member))


def slice_summary(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First labels of the slices a key covers, with the number left out."""
    labels = first_labels(
        signals.select(*keys, slice_label().alias("__label")), keys, "__label", SUMMARY_LABELS, "__labels", True
    )
    more = F.col("__labels_count") - SUMMARY_LABELS
    return labels.select(
        *keys, F.col("__labels_count").alias("slice_count"),
        F.concat(F.array_join("__labels", ", "),
                 F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more slices)"))).otherwise("")
                 ).alias("slice_summary"),
    )


def rollup_clusters(
    signals: DataFrame, whys: DataFrame, kpis: DataFrame, default_start: Column, default_end: Column,
    limit: int | None = None,
) -> DataFrame:
    """One cluster per KPI and WHY window over all slices.

    A KPI with signals but no WHY rows takes the default window; one without signals is reported
    with status `no signals`.
    """
    most = text_limit(limit)
    key = F.lower(F.trim("kpi_name"))
    asked = kpis.select(F.lower(F.trim("kpi_name")).alias("k"), "kpi_name").dropDuplicates(["k"])
    keyed = signals.where(clean("kpi_name") != "").withColumn("k", key)
    summary = slice_summary(keyed, ["k"])
    counts = keyed.groupBy("k").agg(F.count_distinct("signal_id").alias("signal_count"))
    lines = dedupe_whys(whys).withColumns({"k": key, "line": why_line()}).where(
        "period_start is not null and period_end is not null"
    )
    sizes = text_sizes(lines, ["k", "period_start", "period_end"])
    joined = asked.join(counts, "k", "left").join(summary, "k", "left").join(sizes, "k", "left")
    start = F.coalesce("period_start", default_start)
    end = F.coalesce("period_end", default_end)
    chars = F.coalesce("why_chars", F.lit(0))
    status = (
        F.when(F.col("signal_count").isNull(), "no signals").when(chars > most, "skipped").otherwise("kept")
    )
    has = F.col("signal_count").isNotNull()
    return joined.select(
        "kpi_name", F.lit(PORTFOLIO_LABEL).alias("dimension_name"),
        F.when(has, F.coalesce("slice_summary", F.lit("Portfolio"))).alias("dimension_value"),
        F.when(has, period_label(start, end)).alias("period"),
        F.when(has, start).alias("period_start"), F.when(has, end).alias("period_end"),
        F.coalesce("signal_count", F.lit(0)).alias("signal_count"),
        F.coalesce("why_count", F.lit(0)).alias("why_count"), chars.alias("why_chars"), status.alias("status"),
    )
