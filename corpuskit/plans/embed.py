"""Incremental embedding: only chunks without a vector are embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.text import embedding_content, is_blank
from corpuskit.functions.vectors import round_vector
from corpuskit.operators.merge import pending
from corpuskit.operators.quality import check_settings
from corpuskit.operators.ranking import union_all

PLACES = 7


def to_embed(chunks: DataFrame, done: list[DataFrame], with_heading: bool = False) -> DataFrame:
    """(id, content) of the chunks with text and no vector in any `done` table."""
    content = chunks.select("id", embedding_content("text", "heading", with_heading).alias("content"))
    work = content.where(~is_blank("content"))
    return pending(work, union_all([d.select("id") for d in done])) if done else work


def plan_summary(chunks: DataFrame, done: list[DataFrame], with_heading: bool = False) -> DataFrame:
    """One row per state of the chunks: done, blank or to embed. Nothing is written."""
    content = chunks.select("id", embedding_content("text", "heading", with_heading).alias("content"))
    known = union_all([d.select("id") for d in done]).distinct().withColumn("_done", F.lit(True))
    state = F.when(F.col("_done"), "done").when(is_blank("content"), "blank").otherwise("to_embed")
    return content.join(known, "id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("chunks"))


def embed_new(
    chunks: DataFrame,
    done: list[DataFrame],
    embed: Callable,
    model: str,
    dim: int,
    with_heading: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """(id, embedding, model, dim, with_heading) of newly embedded chunks.

    `done` tables that carry settings are checked first: vectors of different
    models, lengths or content modes must not mix. `limit` is for trial runs and
    takes the first ids.
    """
    for table in done:
        if "model" in table.columns:
            check_settings(table, model, dim, with_heading)
    work = to_embed(chunks, done, with_heading)
    if limit is not None:
        work = work.orderBy("id").limit(limit)
    vectors = work.select("id", round_vector(embed(F.col("content")), PLACES).cast("array<float>").alias("embedding"))
    sized = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(
        F.raise_error(F.lit(f"the model must return {dim} values per text")).cast("array<float>")
    )
    return vectors.select(
        "id", sized.alias("embedding"), F.lit(model).alias("model"), F.lit(dim).alias("dim"), F.lit(with_heading).alias("with_heading")
    )


def merge_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with embedding, model and dim; those without a vector stay."""
    stamped = vectors.select("id", "embedding", F.col("model").alias("embedding_model"), F.col("dim").alias("embedding_dim"))
    return chunks.drop("embedding").join(stamped, "id", "left")
