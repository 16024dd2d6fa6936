"""Findings of documents against the requirements that apply to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corpuskit.operators.filters import split_requests
from corpuskit.operators.fusion import FINDINGS_TOP_N
from corpuskit.operators.glossary import definitions_for
from corpuskit.operators.merge import single_rows
from corpuskit.operators.ranking import best_rows
from corpuskit.operators.scorers import STATUSES, checked_status, overlap_classifier
from corpuskit.plans.answers import one_per_clause
from corpuskit.plans.hybrid import retrieve

# Fixed value.
UNCLASSIFIED = "The analysis engine did not return a classification for this clause -- review it manually."


def findings(requirements: DataFrame, classified: DataFrame, by_doc: bool = False, order: str | None = None) -> DataFrame:
    """Every requirement with its classification; one that got none is to be
    reviewed by hand.

    requirements: query_id, clause_id, doc, heading. classified: query_id,
    clause_id (and doc when `by_doc`), status, explanation, evidence. Without
    `by_doc`, two documents sharing a clause id share its classification. Of several
    classifications of a key the last by `order` holds; without an order they fail
    the job.
    """
    keys = ["query_id", "clause_id"] + (["doc"] if by_doc else [])
    classified = best_rows(classified, keys, F.col(order), "last") if order else single_rows(classified, keys)
    answers = classified.select(*keys, checked_status(F.col("status")).alias("_status"), "explanation", "evidence")
    joined = requirements.join(answers, keys, "left")
    return joined.select(
        "query_id", "clause_id", F.coalesce("doc", F.lit("")).alias("doc"), "heading",
        F.coalesce("_status", F.lit("needs_review")).alias("status"),
        F.when(F.col("_status").isNull(), F.lit(UNCLASSIFIED)).otherwise(F.col("explanation")).alias("explanation"),
        "evidence", *_source(requirements),
    )


def _source(requirements: DataFrame) -> list[str]:
    """The address of a requirement goes with its finding where there is one."""
    return ["source_url"] if "source_url" in requirements.columns else []


def status_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per status for every key, each status present even at zero."""
    return found.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def classify(requests: DataFrame, requirements: DataFrame, classifier: Callable = overlap_classifier) -> DataFrame:
    """Findings by a (requirement text, document text) classifier, row by row: the
    search behind the requirements runs once."""
    pairs = requirements.join(requests.select("query_id", "document_text"), "query_id")
    result = classifier(F.coalesce("text", F.lit("")), F.col("document_text"))
    judged = pairs.select("query_id", "clause_id", "doc", "heading", *_source(requirements), result.alias("r"))
    known = F.col("r.status").isNotNull()
    return judged.select(
        "query_id", "clause_id", F.coalesce("doc", F.lit("")).alias("doc"), "heading",
        F.when(known, checked_status(F.col("r.status"))).otherwise(F.lit("needs_review")).alias("status"),
        F.when(known, F.col("r.explanation")).otherwise(F.lit(UNCLASSIFIED)).alias("explanation"),
        F.col("r.evidence").alias("evidence"), *_source(requirements),
    )


def analyse_documents(
    chunks: DataFrame,
    requests: DataFrame,
    glossary: DataFrame,
    top_n: int = FINDINGS_TOP_N,
    classifier: Callable = overlap_classifier,
    **options,
):
    """(findings, definitions, rejected requests).

    requests: query_id, document_text, query_text, qvec, jurisdiction.
    """
    accepted, rejected = split_requests(requests, "document_text", "query_text")
    hits = retrieve(chunks, accepted, top_n, **options)
    ranked = hits.drop("rank").withColumnRenamed("rerank_rank", "rank")
    requirements = one_per_clause(ranked)
    questions = accepted.select("query_id", F.col("query_text").alias("question"))
    definitions = definitions_for(requirements, questions, glossary)
    return classify(accepted, requirements, classifier), definitions, rejected
