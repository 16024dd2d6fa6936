"""Reciprocal rank fusion, payload lookup and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corpuskit.operators.ranking import top_k, union_all
from corpuskit.operators.scorers import token_overlap

# Fixed values.
RRF_K = 60
FUSED_TOP_K = 10
RERANK_POOL = 30
CHAT_TOP_N = 8
FINDINGS_TOP_N = 10

PAYLOAD = [
    "clause_id", "doc", "node_type", "heading", "text", "source_url", "building_classes", "jurisdictions",
    "climate_zones", "applicability_note", "standard_refs", "defined_terms",
]


def fuse(*rankings: DataFrame, rrf_k: int = RRF_K, top: int = FUSED_TOP_K, decimals: int = 9) -> DataFrame:
    """(query_id, id, fused_score, rank): sum over rankings of 1 / (k + rank)."""
    both = union_all([r.select("query_id", "id", "rank") for r in rankings])
    share = F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum(share), decimals).alias("fused_score"))
    return top_k(fused, ["query_id"], [F.col("fused_score").desc(), F.col("id")], top)


def with_payload(hits: DataFrame, chunks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Late materialisation: the wide columns are read only for the fused ids.

    The hit list is a few rows per query, so Spark turns this into a broadcast
    join by its measured size; the chunk scan reads just the asked columns.
    """
    columns = columns or [c for c in PAYLOAD if c in chunks.columns]
    return hits.join(chunks.select("id", *columns), "id")


def rerank(
    hits: DataFrame, queries: DataFrame, top_n: int = FINDINGS_TOP_N, scorer: Callable = token_overlap
) -> DataFrame:
    """Adds rerank_score and rerank_rank, keeps top_n per query. `scorer` takes
    (query text, passage) columns; equal scores keep their fused order."""
    asked = hits.join(queries.select("query_id", "query_text"), "query_id")
    passage = F.coalesce(F.col("text"), F.lit(""))
    scored = asked.withColumn("rerank_score", scorer(F.col("query_text"), passage)).drop("query_text")
    order = [F.col("rerank_score").desc(), F.col("rank")]
    return top_k(scored, ["query_id"], order, top_n, "rerank_rank")
