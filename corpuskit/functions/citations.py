"""Mentions of standards and unlinked citations, found in running text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuskit.functions.text import WHITESPACE, _c, collapse

# Fixed patterns: they decide which mentions exist, so they must not vary.
# White space is any Unicode blank.
STANDARD_MENTION = rf"(?i)\bAS(?:/NZS)?{WHITESPACE}*\d{{2,5}}(?:\.\d+)*(?:{WHITESPACE}*Part{WHITESPACE}*\d+)?\b"
PROSE_CITATION = (
    rf"(?i)\b(?:[A-Z]{{2,3}}{WHITESPACE}+)?(Part|Section|Clause|Table|Figure){WHITESPACE}+"
    r"(\d+(?:\.\d+)*)((?:\([a-zA-Z0-9]+\))*)"
    rf"{WHITESPACE}+of the (?:ABCB )?Housing Provisions"
)


def standard_mentions(text: Column | str) -> Column:
    """Distinct mentions in order of first appearance, white space collapsed."""
    found = F.regexp_extract_all(_c(text), F.lit(STANDARD_MENTION), F.lit(0))
    return F.array_distinct(F.transform(found, collapse))


def normalise_standard(number: Column | str) -> Column:
    """Key form of a standard's number. 'AS 1684 Part 2' keeps its inner blank:
    the result is 'AS 1684 .2'."""
    upper = F.upper(_c(number))
    parts = F.regexp_replace(upper, r"\bPART\s*(\d+)", ".$1")
    slashed = F.regexp_replace(parts, f"{WHITESPACE}*/{WHITESPACE}*", "/")
    return collapse(slashed)


def prose_citations(text: Column | str) -> Column:
    """array<struct<label, number, display, raw_text>>, first of each display kept."""
    found = F.regexp_extract_all(_c(text), F.lit(PROSE_CITATION), F.lit(0))

    def parts(raw: Column) -> Column:
        # The text is searched once; the groups come from the short match.
        word, number, suffix = (F.regexp_extract(raw, PROSE_CITATION, i) for i in (1, 2, 3))
        return F.struct(
            F.lower(word).alias("label"), number.alias("number"),
            F.concat(F.initcap(word), F.lit(" "), number, suffix).alias("display"), raw.alias("raw_text"),
        )

    cited = F.transform(found, parts)

    def first_of_each(found: Column) -> Column:
        displays = F.transform(found, lambda c: c["display"])
        return F.filter(found, lambda c, i: F.array_position(displays, c["display"]) == i + 1)

    # Bound as one item, so that the text is searched once and not once per mention.
    return F.get(F.transform(F.array(cited), first_of_each), 0)
