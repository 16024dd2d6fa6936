"""A dictionary of a corpus's words and their English stems.

Words are reduced to distinct ones in Spark and each is stemmed once, by the
published Porter2 (Snowball English) rules written as column expressions: no Python
runs over words or texts. The dictionary is a table; words that it lacks are found
by an anti-join and appended. Texts meet it in a join by word, and a search asks for
all words of the corpus that share a stem with the question's.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.porter2 import ENGLISH_STOP_WORDS, IRREGULAR, STEP2, STEP3, STEP4, STOP_AFTER_1A
from corpuskit.session import shared_folder


@dataclass(frozen=True)
class Dialect:
    """What two SQL dialects call the same things."""

    like: str = "regexp_like({x}, '{p}')"
    ends: str = "endswith({x}, '{s}')"
    all_after_vowels: str = "regexp_replace({x}, '([aeiouy])y', '$1Y')"


SPARK = Dialect()


def _steps(d: Dialect) -> list[dict[str, str]]:
    """Columns of each step over those of the step before: `w` the word so far, `r1`
    and `r2` where its regions begin, `done` whether later steps are left out."""

    def like(x, p):
        return d.like.format(x=x, p=p)

    def ends(s, x="w"):
        return d.ends.format(x=x, s=s)

    def cut(n, x="w"):
        return f"left({x}, greatest(length({x}) - {n}, 0))"

    def region(x):
        found = f"regexp_extract({x}, '^[^aeiouy]*[aeiouy]+[^aeiouy]', 0)"
        return f"CASE WHEN {found} <> '' THEN length({found}) ELSE length({x}) END"

    def first(cases, otherwise="w"):
        return "CASE WHEN done THEN w " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"

    def suffixes(rules, allowed):
        return first([(ends(old), f"CASE WHEN {allowed(old)} THEN {cut(len(old))} || '{new}' ELSE w END") for old, new in rules])

    def from_(region_name, old):
        return f"length(w) - {len(old)} >= {region_name}"

    def step2(old):
        special = {"ogi": like("w", "logi$"), "li": like("w", "[cdeghkmnrt]li$")}
        return from_("r1", old) + (f" AND {special[old]}" if old in special else "")

    def step4(old):
        return from_("r2", old) + (" AND " + like("w", "[st]ion$") if old == "ion" else "")

    lead = "regexp_extract(w, '^(gener|commun|arsen)', 0)"
    short = "(^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$"
    irregular = " ".join(f"WHEN term = '{k}' THEN '{v}'" for k, v in IRREGULAR.items())
    listed = ", ".join(f"'{x}'" for x in sorted(STOP_AFTER_1A))
    marked = d.all_after_vowels.format(x="CASE WHEN left(term, 1) = 'y' THEN 'Y' || substr(term, 2) ELSE term END")
    step1b = first([
        ("ending = ''", "w"),
        ("ending IN ('eed', 'eedly')", "CASE WHEN length(head) >= r1 THEN head || 'ee' ELSE w END"),
        (f"NOT {like('head', '[aeiouy]')}", "w"),
        (like("head", "(at|bl|iz)$"), "head || 'e'"),
        (like("head", "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), cut(1, "head")),
        (f"length(head) <= r1 AND {like('head', short)}", "head || 'e'"),
    ], "head")
    step5 = first([
        (ends("e"), f"CASE WHEN {from_('r2', 'e')} OR ({from_('r1', 'e')} AND NOT {like(cut(1), short)}) THEN {cut(1)} ELSE w END"),
        (ends("ll"), f"CASE WHEN length(w) - 1 >= r2 THEN {cut(1)} ELSE w END"),
    ])
    step1a = first([
        (ends("sses"), cut(2)),
        (f"{ends('ied')} OR {ends('ies')}", f"CASE WHEN length(w) > 4 THEN {cut(2)} ELSE {cut(1)} END"),
        (f"{ends('s')} AND NOT {ends('us')} AND NOT {ends('ss')} AND {like(cut(2), '[aeiouy]')}", cut(1)),
    ])
    keep = {"term": "term", "r1": "r1", "r2": "r2", "done": "done"}
    return [
        {"term": "term", "done": f"length(term) <= 2 OR term IN ({', '.join(repr(x) for x in IRREGULAR)})",
         "w": f"CASE WHEN length(term) <= 2 THEN term {irregular} ELSE {marked} END"},
        {"term": "term", "done": "done", "w": "w", "r1": f"CASE WHEN {lead} <> '' THEN length({lead}) ELSE {region('w')} END"},
        {"term": "term", "done": "done", "w": "w", "r1": "r1", "rest": "substr(w, r1 + 1)"},
        {"term": "term", "done": "done", "w": "w", "r1": "r1", "r2": f"r1 + {region('rest')}"},
        {**keep, "w": step1a},
        {**keep, "done": f"done OR w IN ({listed})", "w": "w", "ending": "regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$', 0)"},
        {**keep, "w": "w", "ending": "ending", "head": "left(w, length(w) - length(ending))"},
        {**keep, "w": step1b},
        {**keep, "w": first([(f"length(w) > 2 AND {like('w', '[^aeiouy][yY]$')}", f"{cut(1)} || 'i'")])},
        {**keep, "w": suffixes(STEP2, step2)},
        {**keep, "w": suffixes(STEP3, lambda old: from_("r2" if old == "ative" else "r1", old))},
        {**keep, "w": suffixes([(old, "") for old in STEP4], step4)},
        {**keep, "w": step5},
        {"term": "term", "stem": "replace(w, 'Y', 'y')"},
    ]


def stems_sql(source: str, d: Dialect) -> str:
    """(term, stem) of the words in `term` of a table or query, as one SQL query."""
    for step in _steps(d):
        source = "SELECT " + ", ".join(f"{expression} AS {name}" for name, expression in step.items()) + f" FROM ({source})"
    return source


def stems(words: DataFrame) -> DataFrame:
    """(term, stem) of the rows' `term`."""
    for step in _steps(SPARK):
        # A one-row generator keeps the optimizer from copying a step's expressions
        # into every place where the next ones mention them.
        words = words.select(F.inline(F.array(F.struct(*[F.expr(expression).alias(name) for name, expression in step.items()]))))
    return words


def terms_of(tokens: DataFrame) -> DataFrame:
    """The distinct words of `tokens` (array<string>) that are no stop words."""
    words = tokens.select(F.explode("tokens").alias("term"))
    return words.where(F.col("term").isNotNull() & ~F.col("term").isin(*ENGLISH_STOP_WORDS)).distinct()


def build(words: DataFrame, path: str | None = None) -> str:
    """Writes the dictionary of distinct words to `path`, or a new folder in the
    shared one, and gives the path."""
    path = path or f"{shared_folder(words.sparkSession)}/dictionary-{uuid.uuid4().hex}"
    stems(words).write.parquet(path)
    return path


def grow(path: str, words: DataFrame) -> None:
    """Adds the words that the dictionary lacks. One writer at a time."""
    spark = words.sparkSession
    stems(words.join(spark.read.parquet(path), "term", "left_anti")).write.mode("append").parquet(path)


def stemmed(postings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Postings (id, term, pos) with stems for terms; stop words, which the
    dictionary does not hold, go, and leave their places empty."""
    return postings.join(dictionary, "term").select("id", F.col("stem").alias("term"), "pos")


def sharing_stems(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query_id, jurisdiction, terms) from (query_id, jurisdiction, terms): each term
    becomes the words of the dictionary with its stem, put together with `|`. A term
    whose stem no text has stays as its stem, and stop words go."""
    words = queries.select("query_id", F.explode("terms").alias("term")).where(~F.col("term").isin(*ENGLISH_STOP_WORDS))
    known = words.join(stems(words.select("term").distinct()), "term").select("query_id", "stem").distinct()
    # A stem has as many words as a language has endings.
    shared = dictionary.groupBy("stem").agg(F.array_join(F.array_sort(F.collect_list("term")), "|").alias("words"))
    found = known.join(shared, "stem", "left").groupBy("query_id").agg(F.collect_set(F.coalesce("words", "stem")).alias("terms"))
    return queries.drop("terms").join(found, "query_id")
