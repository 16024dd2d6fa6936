"""Hybrid search for a batch of queries: dense and lexical ranks, fused, with
the chunk payload joined on afterwards, and optionally reranked."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.analyzer import Analyzer, query_terms, simple
from corpuskit.operators import inverted
from corpuskit.operators.dense import POOL, dense_top_k
from corpuskit.operators.filters import JURISDICTIONS, checked_jurisdiction
from corpuskit.operators.fusion import (
    FINDINGS_TOP_N,
    FUSED_TOP_K,
    RERANK_POOL,
    RRF_K,
    fuse,
    rerank,
    with_payload,
)
from corpuskit.operators.lexical import lexical_top_k
from corpuskit.operators.scorers import token_overlap
from corpuskit.sizing import store_queries


def hybrid_hits(
    chunks: DataFrame,
    queries: DataFrame,
    top: int = FUSED_TOP_K,
    pool: int = POOL,
    rrf_k: int = RRF_K,
    analyzer: Analyzer = simple,
    jurisdictions: Iterable[str] = JURISDICTIONS,
    index: inverted.Index | None = None,
) -> DataFrame:
    """(query_id, id, fused_score, rank). A jurisdiction is asked for in any case;
    one that is not among `jurisdictions` fails the search. With an `index` of the
    chunks their texts are not read, and the index's analyzer holds."""
    analyzer = index.analyzer if index else analyzer
    asked = queries.select("query_id", "query_text", "qvec", checked_jurisdiction("jurisdiction", jurisdictions).alias("jurisdiction"))
    stored = store_queries(asked.withColumn("terms", query_terms(F.col("query_text"), analyzer)).drop("query_text"))
    lexical = inverted.top_k(index, stored, pool) if index else lexical_top_k(chunks, stored, pool, analyzer)
    return fuse(dense_top_k(chunks, stored, pool), lexical, rrf_k=rrf_k, top=top)


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, top: int = FUSED_TOP_K, payload: list[str] | None = None, **options
) -> DataFrame:
    """Fused hits with their chunk columns.

    chunks: id, node_type, jurisdictions, embedding, heading, text (or tokens)
    and payload. queries: query_id, query_text, qvec, jurisdiction.
    """
    return with_payload(hybrid_hits(chunks, queries, top, **options), chunks, payload)


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    top_n: int = FINDINGS_TOP_N,
    candidates: int = RERANK_POOL,
    scorer: Callable = token_overlap,
    payload: list[str] | None = None,
    **options,
) -> DataFrame:
    """Hybrid search into a candidate pool, then rerank down to top_n per query."""
    hits = hybrid_search(chunks, queries, candidates, payload, **options)
    return rerank(hits, queries, top_n, scorer)
