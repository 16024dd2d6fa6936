"""Writing figure descriptions into chunks that carry only a caption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.text import figure_number_from_file, figure_number_from_heading, figure_text, strip
from corpuskit.operators.filters import undescribed
from corpuskit.operators.merge import update_columns
from corpuskit.operators.ranking import best_rows
from corpuskit.plans.embed import embed_new


def keyed_descriptions(descriptions: DataFrame, order: str) -> DataFrame:
    """(doc, number, description): the last description of a figure number."""
    numbered = descriptions.select(
        "doc", figure_number_from_file("image").alias("number"), "description", F.col(order).alias("_at")
    ).where(F.col("number").isNotNull() & (F.col("description") != ""))
    return best_rows(numbered, ["doc", "number"], F.col("_at"), "last").drop("_at")


def match_figures(chunks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(id, doc, number, heading, text, description, state) of every figure row and
    every description, in one join. state: update, described (already), unmatched
    (a row without description) or unused (a description without row).

    descriptions: doc, number, description, one row per figure.
    """
    rows = (
        chunks.where(F.col("node_type") == "figure")
        .select("id", "doc", "heading", "text", figure_number_from_heading("heading").alias("number"))
    )
    state = (
        F.when(F.col("id").isNull(), "unused")
        .when(F.col("description").isNull(), "unmatched")
        .when(undescribed("text"), "update")
        .otherwise("described")
    )
    return rows.join(descriptions, ["doc", "number"], "full").withColumn("state", state)


def backfill_descriptions(chunks: DataFrame, descriptions: DataFrame, limit: int | None = None):
    """(updated chunks, changed ids). The caption line stays first. Vectors of the
    changed rows are out of date until `reembed`."""
    matched = match_figures(chunks, descriptions).where(F.col("state") == "update")
    if limit is not None:
        matched = matched.orderBy("id").limit(limit)
    heading = F.coalesce(strip("heading"), F.lit(""))
    changes = matched.select("id", figure_text(heading, F.col("description")).alias("text"))
    return update_columns(chunks, changes, ["text"]), changes.select("id")


def reembed(chunks: DataFrame, changed: DataFrame, embed: Callable, model: str, dim: int, with_heading: bool = False) -> DataFrame:
    """Chunks with new vectors for the changed ids; a changed row without text loses
    its vector."""
    ids = changed.select("id").distinct()
    fresh = embed_new(chunks.join(ids, "id", "left_semi"), [], embed, model, dim, with_heading).select("id", "embedding")
    return update_columns(chunks, ids.join(fresh, "id", "left"), ["embedding"])
