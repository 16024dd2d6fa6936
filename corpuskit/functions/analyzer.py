"""Text analyzers: text -> array<string> of terms, one entry per position.

`simple` keeps every word. `english` drops stop words to NULL (their positions
still count) and stems the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from corpuskit.functions.porter2 import ENGLISH_STOP_WORDS, stem_batch
from corpuskit.functions.text import _c

TOKEN = r"[\p{L}\p{N}]+"

Analyzer = Callable[[Column], Column]


def simple(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def simple_with_stops(*stop_words: str) -> Analyzer:
    def analyze(text: Column | str) -> Column:
        return F.transform(simple(text), lambda t: F.when(~t.isin(*stop_words), t))

    return analyze


def english(text: Column | str) -> Column:
    words = simple_with_stops(*ENGLISH_STOP_WORDS)(text)
    return stem_batch(words)


def search_document(heading: Column | str, text: Column | str) -> Column:
    """What is indexed: heading, a blank, text."""
    return F.concat(F.coalesce(_c(heading), F.lit("")), F.lit(" "), F.coalesce(_c(text), F.lit("")))


def query_terms(text: Column | str, analyzer: Analyzer = simple) -> Column:
    """Distinct terms of a query; all of them must be present in a hit."""
    return F.array_distinct(F.filter(analyzer(_c(text)), lambda t: t.isNotNull()))
