"""Personal data: pattern spans, and terms that reveal the protected values by what they occur with.

Built-in functions only. The patterns' matches are protected values. A word beside a value reveals it
when the corpus hardly has the word without the value: its disclosure is the pointwise mutual
information of the two, as a share of the value's own information. Words above the threshold are
spans of kind `term`, to be generalised beside the values themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import settled

#: Kinds in their order, and their patterns. A look-behind and possessive repeats keep
#: the matches of the plain patterns but start once per run, so that long runs take linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
WORD = r"\p{L}\p{N}"
SPAN = "struct<kind:int,start:bigint,end:bigint>"

#: Characters on each side of a value that tell one context of it from another.
CONTEXT = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
#: A cheap test that every text with a match passes.
HINTS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


def _matches(text: Column, pattern: Column, kind: int, valid: Callable[[Column], Column]) -> Column:
    """Spans of a pattern: the lengths of the matches and of the texts between them, added up."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(
        F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size"), valid(m).alias("ok")))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def add(s: Column, p: Column) -> Column:
        start, end = s["at"] + p["gap"], s["at"] + p["gap"] + p["size"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["ok"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(pairs, state, add, lambda s: s["spans"])


def base_spans(text: Column | str) -> Column:
    """Array of (kind, start, end) of all valid pattern matches, by kind and start; code points, end exclusive.

    Matches are leftmost and do not overlap within a kind; failing ones are dropped without retries. A
    null text has none.
    """
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    return F.concat(*[
        F.when(HINTS[k](text), _matches(text, F.lit(PATTERNS[k]), i, CHECKS[k])).otherwise(none) for i, k in enumerate(KINDS)])


def span_list(spans: Column | str, kinds: tuple[str, ...]) -> Column:
    """`kind:start:end` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), rf"[^{WORD}]+"), lambda w: w != ""))


def _near(text: Column, at: Column) -> Column:
    """The text within CONTEXT of a span on both sides, without words that the window cuts."""
    start = F.greatest(at["start"] - CONTEXT, F.lit(1)).cast("int")
    # One character more on each side, where there is one, tells whether the window cuts a word.
    left = F.substring(text, start, (at["start"] - start + 1).cast("int"))
    right = F.substring(text, (at["end"] + 1).cast("int"), F.lit(CONTEXT + 1))
    left = F.when(at["start"] > CONTEXT, F.regexp_replace(left, rf"^[{WORD}]+", "")).otherwise(left)
    right = F.when(F.length(right) > CONTEXT, F.regexp_replace(right, rf"[{WORD}]+$", "")).otherwise(right)
    return F.concat(left, F.lit(" "), right)


def revealing_terms(docs: DataFrame, found: DataFrame, threshold: float, support: int) -> DataFrame:
    """doc_id and `terms` (array): words of a document, wherever they stand, that reveal its protected values.

    `found` has doc_id, text and spans of the documents with spans. Documents count for a value and a
    word wherever both stand in them. Value and word together need `support` different texts, or as many
    contexts of the value with the word in it, so copies add nothing. Sums run over all documents.
    """
    text, at = F.col("text"), F.col("span")
    left = F.substring(text, F.greatest(at["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(at["start"], F.lit(CONTEXT)).cast("int"))
    right = F.substring(text, (at["end"] + 1).cast("int"), F.lit(CONTEXT))
    value = F.lower(F.substring(text, (at["start"] + 1).cast("int"), (at["end"] - at["start"]).cast("int")))
    named = found.where(F.size("spans") > 0).withColumn("which", F.xxhash64("text"))
    places = settled(named.select("which", "text", F.explode("spans").alias("span")).select(
        "which", F.xxhash64(value).alias("value"), F.xxhash64(left, right).alias("place"), _near(text, at).alias("near")
    ).dropDuplicates(["which", "value", "place"]))
    copies = named.groupBy("which").agg(F.count("*").alias("copies"))
    held = settled(places.select("which", "value").distinct().join(copies, "which"))
    own = held.groupBy("value").agg(F.sum("copies").alias("value_docs"), F.count("*").alias("value_texts"))
    contexts = places.groupBy("value").agg(F.count_distinct("place").alias("value_uses"))
    # No other value can have a word together with it often enough.
    often = settled(own.join(contexts, "value").where((F.col("value_texts") >= support) | (F.col("value_uses") >= support)))
    asked = settled(held.join(often.select("value"), "value"))
    texts = named.select("which", "text", "spans").dropDuplicates(["which"]).join(asked.select("which").distinct(), "which", "left_semi")
    apart = _clean(F.col("text"), F.col("spans"), F.lit(" "))
    words = texts.select("which", F.explode(_words(apart)).alias("term"))
    uses = settled(words.join(asked, "which").select("which", "value", "term", "copies"))
    both = uses.groupBy("value", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("both_docs"))
    near = places.join(often.select("value"), "value").select("value", "place", F.explode(_words(F.col("near"))).alias("term")).groupBy(
        "value", "term").agg(F.count_distinct("place").alias("places"))
    pairs = both.join(near, ["value", "term"], "left").where((F.col("texts") >= support) | (F.col("places") >= support))
    known = docs.select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("term_docs"))
    total = F.lit(docs.count())
    # A value's copies also hold the word: its documents are counted for both, so that copies cancel out.
    rated = (
        pairs.join(often, "value").join(known, "term")
        .withColumn("pmi", F.log(F.col("both_docs") * total / (F.col("value_docs") * F.col("term_docs"))))
        .withColumn("information", F.log(total / F.col("value_docs")))
    )
    bad = rated.where((F.col("information") > 0) & (F.col("pmi") >= threshold * F.col("information"))).select("value", "term")
    terms = uses.join(bad, ["value", "term"]).select("which", "term").distinct()
    return named.select("doc_id", "which").join(terms, "which").groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Spans of whole words among `terms`, outside the base spans."""
    pattern = F.concat(F.lit(rf"(?iu)(?<![{WORD}])(?:"), F.array_join(terms, "|"), F.lit(rf")(?![{WORD}])"))
    spans = _matches(text, pattern, len(KINDS), lambda m: F.lit(True))
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def personal_data(docs: DataFrame, threshold: float = 0.8, support: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, base (pattern spans) and terms (spans of revealing words).

    A null text counts as empty. A null doc_id gets its base spans but no terms; rows that share a
    doc_id share its terms, each where they stand in its own text. Other columns are ignored; no rows
    give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    scanned = docs.withColumn("spans", base_spans("text"))
    found = settled(scanned.select("doc_id", F.when(F.size("spans") > 0, F.col("text")).alias("text"), "spans"))
    terms = revealing_terms(docs, found.where("text is not null"), threshold, support)
    extra = found.where("text is not null").join(terms, "doc_id").select(
        "doc_id", F.xxhash64("text").alias("which"), _term_spans(F.col("text"), F.col("terms"), F.col("spans")).alias("terms")
    ).dropDuplicates(["doc_id", "which"])
    none = F.array().cast(f"array<{SPAN}>")
    return found.withColumn("which", F.xxhash64("text")).join(extra, ["doc_id", "which"], "left").select(
        "doc_id", F.col("spans").alias("base"), F.coalesce("terms", none).alias("terms"))


def _clean(text: Column, spans: Column, put: Column | None = None) -> Column:
    """The text with each span (in order of start; overlapping ones as one) replaced by its kind, or by `put`."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(s: Column, p: Column) -> Column:
        piece = F.substring(text, (s["at"] + 1).cast("int"), (p["start"] - s["at"]).cast("int"))
        fresh = F.struct(p["end"].alias("at"), F.concat(s["parts"], F.array(piece, F.get(names, p["kind"]) if put is None else put)).alias("parts"))
        longer = F.struct(F.greatest(s["at"], p["end"]).alias("at"), s["parts"].alias("parts"))
        return F.when(p["start"] >= s["at"], fresh).otherwise(longer)

    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                            .otherwise((b["end"] - a["end"]).cast("int")))
    return F.aggregate(by_start, state, add, lambda s: F.concat(
        F.array_join(s["parts"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def sanitised(docs: DataFrame, threshold: float = 0.8, support: int = 3) -> DataFrame:
    """`docs` with every protected value and revealing word in `text` replaced by its kind in brackets.

    All rows and columns stay; texts without spans, null ones too, are unchanged. n_chars, where there
    is one, becomes the new length of a changed text.
    """
    keyed = docs.withColumn("_spans", base_spans(F.col("text")))
    plain = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = settled(keyed.where(F.size("_spans") > 0).select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("_spans").alias("spans")))
    terms = settled(revealing_terms(plain, found, threshold, support)).withColumnRenamed("doc_id", "_id").withColumnRenamed("terms", "_terms")
    joined = keyed.join(terms, F.col("doc_id").cast("bigint") == F.col("_id"), "left")
    extra = F.when((F.size("_spans") > 0) & F.col("_terms").isNotNull(), _term_spans(F.col("text"), F.col("_terms"), F.col("_spans")))
    every = F.concat("_spans", F.coalesce(extra, F.array().cast(f"array<{SPAN}>")))
    changed = joined.withColumn("_all", every).withColumn("_new", F.when(F.size("_all") > 0, _clean(F.col("text"), F.col("_all"))))
    out = {"text": F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.coalesce(F.length("_new").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return changed.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def count_of(kind: str, spans: Column | str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
