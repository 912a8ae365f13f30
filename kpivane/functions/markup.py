"""Display markup of stored narratives: bold numbers, highlighted slices, section layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind, replace_all, replace_where, rewrite, strip_space, unix_lines

# Patterns of the markup format.
INVISIBLE = "[\ufeff\u200b\u200c\u200d\u2060]"
BOLD = r"\*\*[^*]+\*\*"
LINE_STAR = r"(?m)^\*(?!\*)\s*"
BULLET_STAR = r"•\s*\*(?!\*)"

# What is set in bold, in this order - ISO dates, points, percentages, money,
# grouped numbers, decimals - and the removal of empty pairs. Each rule begins with the sign that every match
# holds; the first test of a pattern is one character, as it is made at every place of a text.
BOLD_RULES: tuple[tuple[str, str, str], ...] = (
    ("-", r"(?=\d)(?<!\*)(\b\d{4}-\d{2}-\d{2}\b)(?!\*)", "**$1**"),
    ("", r"(?i)(?=[+\-\d])(?<!\*)(?<![\d.])([+-]?\d+(?:\.\d+)?)\s*(pp)\b", "**$1 $2**"),
    ("%", r"(?=[+\-\d])(?<!\*)([+-]?\d+(?:,\d{3})*(?:\.\d+)?%)(?!\*)", "**$1**"),
    ("$", r"(?=\$)(?<!\*)(\$\s*[+-]?\d+(?:,\d{3})*(?:\.\d+)?)(?!\*)", "**$1**"),
    (",", r"(?=[+\-\d])(?<!\*)(?<![\d.])([+-]?\d{1,3}(?:,\d{3})+)(?!\*)", "**$1**"),
    (".", r"(?=[+\-\d])(?<!\*)(?<![\d.])([+-]?\d+\.\d+)(?![\d%*])(?!\*)", "**$1**"),
    ("**", r"\*\*\s*\*\*", ""),
)

# What may stand between a dimension's name and its member.
JOINTS = (" — ", " – ", " - ", ": ", ":  ", " / ", " ")
NO_NAME = ("n/a", "na", "—", "-")


def strip_invisible(text: Column) -> Column:
    # Each of them takes three bytes, so a text of one-byte characters has none.
    return bind(text, lambda t: F.when(F.octet_length(t) > F.length(t), F.regexp_replace(t, INVISIBLE, "")).otherwise(t))


def repair_bold(text: Column) -> Column:
    """Undo bold around a single leading letter of a word, and drop escaped stars."""
    # A letter is freed when what follows it, once the lower-case letters after it are freed, is lower case.
    single = replace_where(unix_lines(text), "**", r"\*\*([A-Za-z])\*\*(?=(?:\*\*[a-z]\*\*)*+[a-z])", "$1")
    return replace_where(single, "\\*", r"\\+\*{1,2}", "")


def strip_title(text: Column) -> Column:
    """A title without any star."""
    bare = F.replace(unix_lines(F.coalesce(text, F.lit(""))), F.lit("*"), F.lit(""))
    return strip_space(F.regexp_replace(bare, r"\s{2,}", " "))


def _bullets(text: Column) -> Column:
    """A star at the start of a line, or after a bullet, as a bullet."""
    return bind(text, lambda t: F.when(F.contains(t, F.lit("*")), replace_all(t, [(LINE_STAR, "• "), (BULLET_STAR, "• ")])).otherwise(t))


def normalize_bullets(text: Column) -> Column:
    """`•` for list lines, and no bold left for the next pass to trip over."""
    def marked(clean: Column) -> Column:
        out = _bullets(clean)
        out = F.when(F.contains(clean, F.lit("*")), F.replace(replace_where(
            F.regexp_replace(out, r"(?m)^(•\s*)\*(?!\*)", "$1"), "**", r"\*\*([^*]+?)\*\*", "$1"), F.lit("**"), F.lit(""))).otherwise(clean)
        return F.when(F.trim(clean) == "", clean).otherwise(out)

    return bind(unix_lines(strip_invisible(text)), marked)


def _in_bold(piece: Column) -> Column:
    for sign, pattern, replacement in BOLD_RULES:
        piece = replace_where(piece, sign, pattern, replacement) if sign else F.regexp_replace(piece, pattern, replacement)
    return piece


def bold_numbers(text: Column) -> Column:
    """Dates, numbers and amounts in bold; text that is bold already stays as it is."""
    def marked(clean: Column) -> Column:
        done = rewrite(
            _bullets(repair_bold(clean)), BOLD, lambda b: b,
            lambda p: F.when(p.rlike(r"\d"), _in_bold(p)).otherwise(p),
        )
        return F.when(F.trim(clean) == "", clean).otherwise(done)

    return bind(F.replace(unix_lines(text), F.lit("\u2212"), F.lit("-")), marked)


def _members(value: Column) -> Column:
    """Members of a slice text; `City, ST` stays one member."""
    raw = F.trim(F.coalesce(value, F.lit("")))

    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(raw, pattern), lambda p: F.trim(p)), lambda p: p != "")

    commas = parts(r",\s*")
    second = F.try_element_at(commas, F.lit(2))
    place = (
        (F.size(commas) == 2) & (F.length(second) <= 3)
        & F.replace(second, F.lit("."), F.lit("")).rlike(r"^\p{L}+$")
    )
    return (
        F.when(raw == "", F.array().cast("array<string>"))
        .when(raw.contains(";"), parts(r"\s*;\s*"))
        .when(raw.contains("|"), parts(r"\s*\|\s*"))
        .when(raw.rlike(r"\s/\s"), parts(r"\s+/\s+"))
        .when(raw.contains(",") & ~F.coalesce(place, F.lit(False)), commas)
        .otherwise(F.array(raw))
    )


def slice_phrases(name: Column, value: Column, most: int | None = None) -> Column:
    """Phrases that may name a slice in prose, longest first; `most` keeps only the longest ones."""
    def variants(member: Column) -> Column:
        forms = F.array(
            member, F.replace(member, F.lit("-"), F.lit(" ")), F.replace(member, F.lit("-"), F.lit(" – "))
        )
        return F.transform(forms, lambda m: F.trim(F.regexp_replace(m, r"\s+", " ")))

    members = F.filter(F.flatten(F.transform(_members(value), variants)), lambda m: F.length(m) >= 2)
    raw = F.trim(F.coalesce(name, F.lit("")))
    spoken = F.trim(F.replace(raw, F.lit("_"), F.lit(" ")))
    spoken_ok = (F.length(spoken) >= 2) & ~F.lower(spoken).isin(*NO_NAME)
    own = F.filter(F.array(F.when(spoken_ok, spoken), F.when(F.length(raw) >= 2, raw)), lambda p: p.isNotNull())

    def combos(member: Column) -> Column:
        return F.array(*[
            F.when(
                F.lit(joint != " ") | ((F.length(spoken) >= 4) & (F.length(member) >= 4)),
                F.concat(spoken, F.lit(joint), member),
            ) for joint in JOINTS
        ])

    joined = F.when(spoken != "", F.flatten(F.transform(members, combos))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.filter(F.concat(members, own, joined), lambda p: p.isNotNull()))
    ranked = F.array_sort(F.transform(every, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    return F.transform(F.slice(ranked, 1, most) if most else ranked, lambda s: s["p"])


def highlight(text: Column, name: Column, value: Column) -> Column:
    """Slice phrases in bold, whole words only, outside what is bold already."""
    def pattern(phrase: Column) -> Column:
        quoted = F.regexp_replace(phrase, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        # The phrase is looked for first: what stands before it is tested only where it stands.
        return F.concat(F.lit("(?iu)(?="), quoted, F.lit(r")(?<![\p{L}\p{N}])(?<!(?<!\*)\*)"), quoted, F.lit(r"(?![\p{L}\p{N}])"))

    def wrap(acc: Column, phrase: Column) -> Column:
        return bind(pattern(phrase), lambda whole: rewrite(
            acc, BOLD, lambda b: b, lambda p: F.regexp_replace(p, whole, F.lit("**$0**"))))

    def wrapped(ready: Column) -> Column:
        # Wrapping adds stars only, so a phrase that the text lacks at first never appears later.
        present = bind(F.lower(ready), lambda low: F.filter(slice_phrases(name, value), lambda p: F.contains(low, F.lower(p))))
        return F.aggregate(present, ready, wrap)

    return repair_bold(bind(repair_bold(strip_invisible(text)), wrapped))


def reformat_body(text: Column, name: Column, value: Column) -> Column:
    """Markup pass of a stored narrative field; blank fields stay as they are."""
    done = repair_bold(highlight(bold_numbers(normalize_bullets(text)), name, value))
    return F.when(F.trim(text) == "", text).otherwise(done)


# --- section layout ---------------------------------------------------------------------------

# Forms of a section header and limits of a bare title line.
WRAPPED_HEADER = r"(?is)^<sub>\s*(\*\*.+?\*\*)\s*</?sub>\s*$"
BOLD_LINE = r"^\*\*.+\*\*$"
TITLE_LEFT = r"^[A-Za-z0-9][A-Za-z0-9 &./'\-]{0,54}$"


def _title_line(line: Column) -> Column:
    """True for a bare `Theme — Observation` title line."""
    dash = F.when(line.contains(" — "), " — ").when(line.contains(" – "), " – ")
    at = F.position(dash, line)
    left = F.trim(F.substring(line, F.lit(1), at - 1))
    right = F.trim(F.substring(line, at + 3, F.length(line)))
    first = F.regexp_replace(right, r"^\*\*.*?\*\*\s*", "")
    ok = (
        F.length(left).between(2, 55) & (F.length(right) >= 12) & ~left.contains("*") & ~left.contains(",")
        & (F.size(F.split(left, r"\s+")) <= 6) & left.rlike(TITLE_LEFT) & first.rlike(r"^[\p{Lu}\p{Nd}]")
    )
    return F.coalesce(ok, F.lit(False))


def _section_row(line: Column) -> Column:
    """Kind of a trimmed line (bullet, header, paragraph) and how it is shown."""
    bullet, dashed = line.startswith("•"), F.left(line, F.lit(1)).isin("-", "*") & line.rlike(r"^[\-*]\s+\S")
    wrapped, bold = line.startswith("<") & line.rlike(WRAPPED_HEADER), line.startswith("**") & line.rlike(BOLD_LINE)

    def header(shown: Column) -> Column:
        return F.struct(F.lit("h").alias("kind"), F.concat(F.lit("<sub>"), shown, F.lit("<sub>")).alias("body"))

    def row(kind: str, shown: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), shown.alias("body"))

    return (
        F.when(bullet, row("b", line))
        .when(dashed, row("b", F.regexp_replace(line, r"^[\-*]\s+", "• ")))
        .when(wrapped, header(F.regexp_extract(line, WRAPPED_HEADER, 1)))
        .when(bold, header(line))
        .when(_title_line(line), header(F.concat(F.lit("**"), line, F.lit("**"))))
        .otherwise(row("p", line))
    )


def layout_sections(text: Column) -> Column:
    """Headers, bullet groups and paragraphs with fixed spacing; text without headers keeps its lines."""
    def spaced(rows: Column) -> Column:
        """Each line after its separator: one break between bullets, a blank line elsewhere."""
        before = F.concat(F.array(F.lit("")), F.transform(rows, lambda r: r["kind"]))

        def piece(r: Column, was: Column) -> Column:
            gap = F.when(was == "", "").when((was == "b") & (r["kind"] == "b"), "\n").otherwise("\n\n")
            return F.concat(gap, r["body"])

        return F.array_join(F.zip_with(rows, F.slice(before, 1, F.size(rows)), piece), "")

    def laid_out(clean: Column) -> Column:
        lines = F.filter(F.transform(F.split(clean, "\n"), strip_space), lambda x: x != "")
        merged = bind(
            F.transform(lines, _section_row),
            lambda rows: F.when(F.exists(rows, lambda r: r["kind"] == "h"), spaced(rows)).otherwise(clean),
        )
        ended = F.concat(F.regexp_replace(merged, r"\s+$", ""), F.lit("\n"))
        return F.when(strip_space(clean) == "", "").otherwise(ended)

    return bind(unix_lines(repair_bold(strip_invisible(F.coalesce(text, F.lit(""))))), laid_out)


# --- drift check ------------------------------------------------------------------------------


def plain_text(text: Column) -> Column:
    """Text without markup and with single blanks, for telling wording from formatting."""
    def has_marks(t: Column) -> Column:
        return F.contains(t, F.lit("**")) | (F.contains(t, F.lit("<")) & t.rlike("(?i)<sub>"))

    def state(t: Column, was: Column | None = None) -> Column:
        return F.struct(t.alias("text"), (has_marks(t) if was is None else has_marks(t) & (t != was)).alias("more"))

    def once(t: Column) -> Column:
        return replace_where(replace_where(t, "<", r"(?is)<sub>\s*(.*?)\s*</?sub>", "$1"), "**", r"(?s)\*\*(.+?)\*\*", "$1")

    def opened(start: Column) -> Column:
        # Every pass that changes anything takes away a mark, so there are no more passes than marks; a pass that
        # changes nothing, or leaves no mark, is the last.
        passes = F.size(F.split(start, r"\*\*|(?i)<sub>"))
        done = F.aggregate(
            F.sequence(F.lit(1), passes), state(start),
            lambda acc, _: F.when(acc["more"], bind(once(acc["text"]), lambda t: state(t, acc["text"]))).otherwise(acc),
            lambda acc: acc["text"])
        return F.when(has_marks(start), done).otherwise(start)

    # A single blank stays as it is.
    return strip_space(F.regexp_replace(bind(unix_lines(F.coalesce(text, F.lit(""))), opened), r"\s{2,}|[^\S ]", " "))


def plain_sections(text: Column) -> Column:
    """`plain_text` that also ignores list marks and kinds of dash."""
    lines = replace_all(F.coalesce(text, F.lit("")), [
        (r"(?is)<sub>\s*(.*?)\s*</?sub>", "$1"), (r"(?m)^\s*[•\-*]\s+", ""), ("•", " "), ("[—–]", "-"),
    ])
    return plain_text(lines)


def drifted(before: Column, after: Column, sections: bool = False) -> Column:
    """True when two texts differ in wording, not only in markup."""
    form = plain_sections if sections else plain_text
    return form(before) != form(after)


BODY_FIELDS = ("insight", "why", "insight_summary", "why_insight_summary", "impact_insight", "recommended_actions")


def reformat_insights(insights: DataFrame) -> DataFrame:
    """The markup job over a table of narratives: title, bodies, and the layout of `why`."""
    name, value = F.col("dimension_name"), F.col("dimension_value")
    changed = {c: reformat_body(F.col(c), name, value) for c in BODY_FIELDS if c in insights.columns}
    if "why" in changed:
        changed["why"] = F.when(F.col("why").isNotNull(), layout_sections(changed["why"]))
    if "insight" in changed:
        changed["insight"] = F.coalesce(changed["insight"], F.lit(""))
    if "title" in insights.columns:
        changed["title"] = strip_title(F.col("title"))
    return insights.withColumns(changed)
