"""Context for an answer, and the audit of the answer that came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.text import blank_to_null, context_block, definition_line, is_blank, requirement_block, strip
from corpuskit.operators.filters import MIN_RERANK_SCORE, citable, parse_answer
from corpuskit.operators.glossary import definitions_for, quoted_definitions
from corpuskit.operators.ranking import best_rows, union_all

# Fixed value.
UNNAMED_ATTACHMENT = "the attached document"


def ordered_text(rows: DataFrame, keys: list[str], order: str, line, separator: str, name: str) -> DataFrame:
    """One text per key from its lines in order. Lists are as long as a query's
    kept hits or definitions, which are capped upstream."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), separator).alias(name))


def abstain_gate(questions: DataFrame, hits: DataFrame, floor: float = MIN_RERANK_SCORE) -> DataFrame:
    """questions with strong_match and abstained. A question abstains when no hit
    clears the floor and it brings no attachment.

    questions: query_id, question, attachment_name, attachment_text.
    """
    best = hits.groupBy("query_id").agg(F.max("rerank_score").alias("_top"))
    strong = F.coalesce(F.col("_top") >= floor, F.lit(False))
    return (
        questions.join(best, "query_id", "left")
        .withColumn("strong_match", strong)
        .withColumn("abstained", ~strong & is_blank("attachment_text"))
        .drop("_top")
    )


def build_context(questions: DataFrame, hits: DataFrame, glossary: DataFrame, floor: float = MIN_RERANK_SCORE) -> DataFrame:
    """(query_id, prompt) for every question that does not abstain.

    hits: the reranked chunks, with rerank_rank and the payload columns.
    """
    gated = abstain_gate(questions, hits, floor).where(~F.col("abstained"))
    strong = gated.where("strong_match").select("query_id")
    kept = hits.join(strong, "query_id", "left_semi")
    blocks = ordered_text(kept, ["query_id"], "rerank_rank", context_block(), "\n\n", "context")
    asked = gated.where("strong_match").select("query_id", "question")
    definitions = definitions_for(kept.drop("rank").withColumnRenamed("rerank_rank", "rank"), asked, glossary)
    lines = ordered_text(definitions, ["query_id"], "ord", definition_line("term", "definition"), "\n", "definitions")
    attachment = blank_to_null(strip("attachment_text"))
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("CONTEXT:\n"), F.coalesce("context", F.lit("(none retrieved)"))),
        F.concat(F.lit("DEFINITIONS:\n"), F.col("definitions")),
        F.when(
            attachment.isNotNull(),
            F.concat(F.lit("ATTACHED DOCUMENT ("), F.coalesce(blank_to_null("attachment_name"), F.lit(UNNAMED_ATTACHMENT)), F.lit("):\n"), attachment),
        ),
        F.concat(F.lit("QUESTION: "), F.col("question")),
    )
    return gated.join(blocks, "query_id", "left").join(lines, "query_id", "left").select("query_id", prompt.alias("prompt"))


def build_requirements(documents: DataFrame, hits: DataFrame, definitions: DataFrame) -> DataFrame:
    """(query_id, prompt) setting a document against its requirement chunks."""
    blocks = ordered_text(hits, ["query_id"], "rank", requirement_block(), "\n\n", "requirements")
    lines = ordered_text(definitions, ["query_id"], "ord", definition_line("term", "definition"), "\n", "definitions")
    prompt = F.concat_ws(
        "\n\n",
        F.concat(F.lit("REQUIREMENTS:\n"), F.col("requirements")),
        F.concat(F.lit("DEFINITIONS:\n"), F.col("definitions")),
        F.concat(F.lit("DOCUMENT:\n"), F.col("document_text")),
    )
    return documents.join(blocks, "query_id").join(lines, "query_id", "left").select("query_id", prompt.alias("prompt"))


def one_per_clause(hits: DataFrame, order: str = "rank") -> DataFrame:
    """The first hit of every (clause_id, doc) in relevance order; hits without
    a clause id go."""
    named = hits.where(blank_to_null("clause_id").isNotNull())
    return best_rows(named, ["query_id", "clause_id", "doc"], F.col(order), "first")


def citations(hits: DataFrame, order: str = "rank") -> DataFrame:
    """Citable hits, one per clause. Header rows are dropped first, so that they
    cannot shadow a later real chunk of the same clause."""
    return one_per_clause(hits.where(citable()), order)


def audit_answers(answers: DataFrame, hits: DataFrame, definitions: DataFrame):
    """(verdicts, citations): verdicts has query_id, abstained, answer; citations
    has query_id, source, ord, clause_id, doc, text, and of heading, source_url and
    the applicability of the hits what they carry; it is empty for abstains.

    hits: the context chunks of each query (query_id, rank, payload).
    """
    parsed = answers.select("query_id", parse_answer("answer").alias("p")).select("query_id", "p.*")
    given = parsed.where(~F.col("abstained"))
    carried = [c for c in ("heading", "source_url", "building_classes", "jurisdictions", "climate_zones", "applicability_note") if c in hits.columns]
    chunk_cites = citations(hits.join(given.select("query_id"), "query_id", "left_semi")).select(
        "query_id", F.lit("chunk").alias("source"), F.col("rank").cast("int").alias("ord"), "clause_id",
        F.coalesce("doc", F.lit("")).alias("doc"), "text", *carried,
    )
    blank = [F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in carried]
    quoted = quoted_definitions(given, definitions).select(
        "query_id", F.lit("definition").alias("source"), F.col("ord").cast("int").alias("ord"), "clause_id", "doc", "text", *blank
    )
    return parsed, union_all([chunk_cites, quoted])
