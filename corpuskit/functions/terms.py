"""Whole-word term matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuskit.functions.text import _c

# Fixed value: what counts as a word character on both sides of a term.
WORD = r"[\p{L}\p{N}_]"


def is_case_sensitive(term: Column | str) -> Column:
    """Short terms and those with a capital after the first letter are abbreviations."""
    term = _c(term)
    tail = term.substr(F.lit(2), F.length(term))
    return (F.length(term) <= 3) | (tail != F.lower(tail))


def term_pattern(term: Column | str) -> Column:
    term = _c(term)
    escaped = F.regexp_replace(term, r"([^\p{L}\p{N}_])", r"\\$1")
    flags = F.when(is_case_sensitive(term), F.lit("")).otherwise(F.lit("(?iu)"))
    return F.concat(flags, F.lit(f"(?<!{WORD})"), escaped, F.lit(f"(?!{WORD})"))


def term_in_question(term: Column | str, question: Column | str) -> Column:
    """True when `question` holds `term` as a whole word. One-character terms never match."""
    term = _c(term)
    return (F.length(term) > 1) & F.rlike(_c(question), term_pattern(term))


def words(text: Column | str) -> Column:
    """Runs of word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(f"{WORD}+"), F.lit(0))


def signs(text: Column | str) -> Column:
    """The characters that stand in no word."""
    return F.regexp_extract_all(_c(text), F.lit(r"[^\p{L}\p{N}_]"), F.lit(0))


def sign_key(sign: Column) -> Column:
    """Keeps signs apart from words where both are keys."""
    return F.concat(F.lit("\u0001"), sign)


def join_word(term: Column | str) -> Column:
    """First word of a term, or the key of its first sign if it has none. A
    whole-word hit always has this among the question's own, so it serves as an
    equi-join key."""
    return F.coalesce(F.get(words(term), 0), sign_key(F.get(signs(term), 0)))
