"""Clean-up rules for narrative text columns. Everything stays in built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tokens such as `Branch_Name`.
SNAKE_LABEL = r"\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b"

# Analyst wording and the business wording that replaces it, in order.
JARGON: tuple[tuple[str, str], ...] = (
    (r",\s*but\s+one\s+WHY\s+rows?\s+shows\b", "; the rolling-baseline comparison shows"),
    (r"\bbut\s+one\s+WHY\s+rows?\s+shows\b", "but the rolling-baseline comparison shows"),
    (r"\bone\s+WHY\s+rows?\s+shows\b", "the analysis shows"),
    (r"\bone\s+WHY\s+rows?\b", "one view"),
    (r"\bWHY\s+rows?\b", "drivers"),
    (r"\bsignal\s+rows?\b", "alerts"),
    (r"\bwhy_results\b", "the evidence"),
    (r"\bsignal_log\b", "the readings"),
)

# Scaffolding labels, at the start of a line and anywhere.
ROUTE_DASH = r"[—\-]"
ROUTE_LABELS = (
    rf"Route\s*2\s*{ROUTE_DASH}\s*KPI\s*dependency:\s*",
    rf"Route\s*2\s*{ROUTE_DASH}\s*metric\s*dependency:\s*",
    rf"Route\s*1\s*{ROUTE_DASH}\s*inter-dimensional:\s*",
)
ROUTE_PREFIXES = (*ROUTE_LABELS, rf"Route\s*2\s*{ROUTE_DASH}\s*", rf"Route\s*1\s*{ROUTE_DASH}\s*")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and let `use` refer to it as often as it likes."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rewrite(
    text: Column, pattern: str, matched: Callable[[Column], Column], plain: Callable[[Column], Column] | None = None
) -> Column:
    """Apply one function to every match of a pattern and another to the text between matches."""
    def pieces(whole: Column) -> Column:
        between = F.split(whole, pattern, -1)
        if plain is not None:
            between = F.transform(between, plain)
        found = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), matched)
        joined = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.array_join(joined, "")

    return bind(text, pieces)


def replace_all(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def replace_where(text: Column, sign: str, pattern: str, replacement: str) -> Column:
    """`regexp_replace` for a pattern that matches nothing in a text without `sign`; a plain search is far cheaper."""
    return bind(text, lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, replacement)).otherwise(t))


def unix_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def humanize_labels(text: Column) -> Column:
    """`Word_Word` tokens as capitalised words."""
    def words(whole: Column) -> Column:
        named = rewrite(whole, SNAKE_LABEL, lambda t: F.initcap(F.regexp_replace(t, "_+", " ")))
        return F.when(F.trim(whole) == "", whole).otherwise(named)

    return bind(text, words)


def humanize_metrics(label: Column) -> Column:
    """Comma-separated metric names as readable names."""
    parts = F.transform(F.split(F.coalesce(label, F.lit("")), ","), lambda p: humanize_labels(F.trim(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), ", ")


def name_metrics(text: Column, label: Column | None = None) -> Column:
    """Vague `KPI` wording replaced by the metric's name, or by general words for several metrics."""
    raw = F.trim(F.coalesce(label if label is not None else F.lit(""), F.lit("")))

    def quoted(value: Column) -> Column:
        return F.regexp_replace(value, r"([\\$])", r"\\$1")

    def swapped(name: Column) -> Column:
        single = (raw != "") & ~raw.contains(",") & (F.length(raw) <= 240) & (name != "")
        first = F.trim(F.element_at(F.split(name, ","), 1))
        named = F.when(single, name).when(first != "", first).otherwise("the metrics")
        out = text
        for pattern, new in (
            (r"\bcurrent KPIs?\b", F.concat(F.lit("current "), F.when(single, name).otherwise("reading"))),
            (r"\bprior KPIs?\b", F.concat(F.lit("prior "), F.when(single, name).otherwise("reading"))),
            (r"\bmain KPIs?\b", named), (r"\bthe KPIs?\b", named), (r"\bKPIs\b", F.lit("metrics")),
            (r"\bKPI\b", F.when(single, name).otherwise("metric")),
        ):
            out = F.regexp_replace(out, F.lit(f"(?i){pattern}"), quoted(new))
        return out

    return bind(humanize_metrics(raw), swapped)


def polish(text: Column, label: Column | None = None) -> Column:
    return F.coalesce(name_metrics(humanize_labels(text), label), F.lit(""))


def scrub_jargon(text: Column) -> Column:
    out = replace_all(unix_lines(text), [(f"(?i){p}", r) for p, r in JARGON])
    return F.trim(F.regexp_replace(F.regexp_replace(out, "  +", " "), r"\n{3,}", "\n\n"))


def strip_routes(text: Column) -> Column:
    """Remove scaffolding labels from each line, then those left in mid-line."""
    def line(value: Column) -> Column:
        value = replace_all(value, [(rf"(?i)^\s*{p}", "") for p in ROUTE_PREFIXES])
        value = F.regexp_replace(value, r"(?i)\s*\(Route\s*[12]\)\s*", " ")
        return F.trim(F.regexp_replace(value, "  +", " "))

    merged = F.array_join(F.transform(F.split(unix_lines(text), "\n"), line), "\n")
    return F.trim(replace_all(merged, [(f"(?i){p}", "") for p in ROUTE_LABELS]))


def strip_space(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bullet_items(text: Column) -> Column:
    """Plain bullet bodies of free-form text."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\r\n¶•]", -1)
    bare = F.transform(parts, lambda p: strip_space(F.regexp_replace(strip_space(p), r"^[-*–—]\s*", "")))
    return F.filter(bare, lambda p: p != "")


def bullets(text: Column, most: int | None = None) -> Column:
    """One `• ` line per item, or for the first `most`; NULL without any."""
    items = bullet_items(text) if most is None else F.slice(bullet_items(text), 1, most)
    lines = F.array_join(F.transform(items, lambda p: F.concat(F.lit("• "), p)), "\n")
    return F.when(F.size(items) > 0, lines)


def fixed_bullets(text: Column, count: int, padding: Sequence[str]) -> Column:
    """Exactly `count` bullet lines, padded only when there is at least one; blank stays blank."""
    numbered = F.transform(bullet_items(text), lambda p: strip_space(F.regexp_replace(p, r"^\d*\.?\s+", "")))
    items = F.filter(numbered, lambda p: p != "")
    filler = F.array(*[F.lit(padding[i % len(padding)]) for i in range(count)])
    lines = F.transform(F.slice(F.concat(items, filler), 1, count), lambda p: F.concat(F.lit("• "), p))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise("")


def tags(text: Column, most: int | None = None) -> Column:
    """The tags of a comma- or semicolon-separated list, or the first `most`."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), strip_space), lambda p: p != "")
    return F.array_join(parts if most is None else F.slice(parts, 1, most), ", ")


def first_words(text: Column, most: int) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, most), " ")


# Colour marks of a summary line, and the one it gets when it has none.
COLOUR_MARKS = ("/green", "/red")
DEFAULT_MARK = "/red"
PLAIN_WORDS, COLOURED_WORDS = 10, 30


def pointers(items: Column, padding: str, count: int = 5, words: int | None = None, coloured: bool = False) -> Column:
    """Exactly `count` summary lines of at most `words` words (10, or 30 with colour); short lists are padded.

    A coloured line keeps its mark; one without gets the default mark, as does the padding.
    """
    most = words or (COLOURED_WORDS if coloured else PLAIN_WORDS)
    lines = F.filter(F.transform(items, lambda x: first_words(x, most)), lambda x: x != "")
    filler = padding
    if coloured:
        def marked(line: Column) -> Column:
            has = F.lit(False)
            for mark in COLOUR_MARKS:
                has = has | line.contains(mark)
            return F.when(has, line).otherwise(F.concat(line, F.lit(f" {DEFAULT_MARK}")))

        lines, filler = F.transform(lines, marked), f"{padding} {DEFAULT_MARK}"
    return F.slice(F.concat(lines, F.array_repeat(F.lit(filler), count)), 1, count)


def mention_period(text: Column, windows: Column) -> Column:
    """Add the period when the text names no ISO date."""
    clean = strip_space(F.coalesce(text, F.lit("")))
    hint = F.when(
        F.lower(windows).contains("mixed"),
        F.concat(F.lit("Periods are mixed; representative windows: "), windows, F.lit(".")),
    ).otherwise(F.concat(F.lit("Period window: "), windows, F.lit(".")))
    usable = F.coalesce((F.trim(windows) != "") & ~F.lower(windows).startswith("n/a"), F.lit(False))
    joint = F.when(clean.rlike(r"[.!?]$"), " ").otherwise(". ")
    return F.when(
        (clean == "") | clean.rlike(r"\b\d{4}-\d{2}-\d{2}\b") | ~usable, clean
    ).otherwise(F.concat(clean, joint, hint))
