"""Glossary lookups for a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.terms import join_word, sign_key, signs, term_in_question, words
from corpuskit.functions.text import blank_to_null, squash, strip
from corpuskit.operators.ranking import best_rows, top_k, union_all

# Fixed values.
MAX_DEFINITIONS = 15
DEFINITIONS_DOC = "NCC Schedule 1 -- Definitions"


def glossary_terms(chunks: DataFrame) -> DataFrame:
    """(term, definition, gid): the first row by id of every stripped heading."""
    rows = chunks.where((F.col("node_type") == "glossary") & F.col("heading").isNotNull())
    terms = rows.select(strip("heading").alias("term"), F.coalesce("text", F.lit("")).alias("definition"), F.col("id").alias("gid"))
    return best_rows(terms, ["term"], F.col("gid"), "first")


def terms_in_questions(questions: DataFrame, glossary: DataFrame) -> DataFrame:
    """(query_id, term, gid) for every term a question holds as a whole word.

    An equi-join on the term's first word (its first sign, if it has no word), then
    the exact test: no question is paired with a term whose first word it lacks.
    """
    keyed = glossary.where(F.length("term") > 1).select("term", "gid", join_word("term").alias("_word"))
    keys = F.array_distinct(F.concat(words("question"), F.transform(signs("question"), sign_key)))
    tokens = questions.select("query_id", "question", F.explode(keys).alias("_word"))
    return tokens.join(keyed, "_word").where(term_in_question("term", "question")).select("query_id", "term", "gid")


def definitions_for(
    hits: DataFrame, questions: DataFrame, glossary: DataFrame, cap: int = MAX_DEFINITIONS
) -> DataFrame:
    """(query_id, term, definition, ord): terms of the question, longest first,
    then the hits' defined_terms in rank order; each once, at most `cap`.

    hits: query_id, rank, defined_terms. Terms without a definition are skipped
    before the cap is applied.
    """
    usable = glossary.where(blank_to_null("definition").isNotNull())
    # Only the first `cap` of a question's own terms can be kept: they come first.
    asked = top_k(
        terms_in_questions(questions, usable), ["query_id"], [F.length("term").desc(), F.col("gid"), F.col("term")], cap, "n"
    ).select("query_id", "term", F.struct(F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(0).alias("c")).alias("place"))
    linked = hits.select("query_id", "rank", F.posexplode("defined_terms").alias("pos", "term")).select(
        "query_id", "term", F.struct(F.lit(1).alias("a"), F.col("rank").alias("b"), F.col("pos").alias("c")).alias("place")
    )
    linked = linked.join(usable.select("term"), "term", "left_semi").select("query_id", "term", "place")
    wanted = union_all([asked, linked]).groupBy("query_id", "term").agg(F.min("place").alias("place"))
    kept = top_k(wanted, ["query_id"], [F.col("place"), F.col("term")], cap, "ord")
    return kept.join(usable.select("term", "definition"), "term").select("query_id", "term", "definition", "ord")


def quoted_definitions(answers: DataFrame, definitions: DataFrame, probe_chars: int = 40) -> DataFrame:
    """Definitions whose opening words an answer quotes, one citation each."""
    probe = F.substring(squash("definition"), 1, probe_chars)
    joined = answers.select("query_id", "answer").join(definitions, "query_id")
    quoted = (probe != "") & F.contains(squash("answer"), probe)
    return joined.where(quoted).select(
        "query_id", F.col("term").alias("clause_id"), F.lit(DEFINITIONS_DOC).alias("doc"), strip("definition").alias("text"), "ord"
    )


def quoted_openings(answers: DataFrame, items: DataFrame, probe_chars: int = 40) -> DataFrame:
    """(query_id, item_id): the texts (query_id, answer) that hold the first
    `probe_chars` characters of an item (item_id, text), case and white space aside.

    Words inside a probe stand whole in a text that holds it; its first and last
    may be parts of longer ones. So a probe of three words or more is looked up by
    a word pair or word of its inside, and a shorter one by its first letters; the
    letters of the texts are only listed when there are such probes.
    """
    probes = items.select("item_id", F.substring(squash("text"), 1, probe_chars).alias("probe")).where(F.col("probe") != "")
    parts = F.split("probe", " ")
    inner = F.when(F.size(parts) >= 4, F.concat_ws(" ", F.get(parts, 1), F.get(parts, 2))).when(F.size(parts) == 3, F.get(parts, 1))
    said = answers.select("query_id", F.explode(F.array(squash("answer"))).alias("squashed"))
    spoken = said.withColumn("w", F.split("squashed", " "))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    keys = spoken.select("query_id", F.explode(F.array_distinct(F.concat("w", pairs))).alias("key"))
    near = [keys.join(probes.withColumn("key", inner).where(F.col("key").isNotNull()), "key")]
    short = probes.where(F.size(parts) < 3).withColumn("key", F.substring("probe", 1, 3))
    if not short.isEmpty():
        places = F.sequence(F.lit(1), F.greatest(F.length("squashed"), F.lit(1)))
        runs = F.flatten(F.transform(places, lambda i: F.array(*[F.col("squashed").substr(i, F.lit(n)) for n in (1, 2, 3)])))
        near.append(said.select("query_id", F.explode(F.array_distinct(runs)).alias("key")).join(short, "key"))
    found = union_all([n.select("query_id", "item_id", "probe") for n in near]).distinct()
    return said.join(found, "query_id").where(F.contains("squashed", F.col("probe"))).select("query_id", "item_id").distinct()
