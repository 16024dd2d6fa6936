"""Conversation histories and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.text import blank_to_null, chat_title, model_role
from corpuskit.operators.ranking import best_rows, ordered_positions, top_k

HISTORY = 6


def recent_history(messages: DataFrame, last: int = HISTORY) -> DataFrame:
    """The last messages of every conversation, then without the empty ones.
    Empty messages still use up a place. Unknown roles count as the user's.

    messages: conversation_id, turn, role, text.
    """
    recent = top_k(messages, ["conversation_id"], [F.col("turn").desc()], last, "_back").drop("_back")
    return recent.where(blank_to_null("text").isNotNull()).select(
        "conversation_id", "turn", model_role("role").alias("role"), "text"
    )


def answered_pairs(messages: DataFrame) -> DataFrame:
    """(conversation_id, pair, question, answer): messages taken two by two by
    position; kept when a user message is followed by an assistant reply that
    is not an error. A message without a partner is dropped.

    Positions are numbered in ranges of `turn`, so one huge conversation does
    not have to be sorted in one task.
    """
    placed = ordered_positions(messages, ["conversation_id"], "turn")
    pair = F.floor((F.col("position") - 1) / 2)
    first, second = F.col("position") % 2 == 1, F.col("position") % 2 == 0
    error = F.coalesce(F.col("is_error"), F.lit(False))
    return (
        placed.groupBy("conversation_id", pair.cast("long").alias("pair"))
        .agg(
            F.max(F.when(first & (F.col("role") == "user"), F.struct("text"))).alias("_q"),
            F.max(F.when(second & (F.col("role") == "assistant") & ~error, F.struct("text"))).alias("_a"),
        )
        .where(F.col("_q").isNotNull() & F.col("_a").isNotNull())
        .select("conversation_id", "pair", F.col("_q.text").alias("question"), F.col("_a.text").alias("answer"))
    )


def titles(messages: DataFrame) -> DataFrame:
    """(conversation_id, title) from the first message."""
    first = best_rows(messages.select("conversation_id", "turn", "text"), ["conversation_id"], F.col("turn"), "first")
    return first.select("conversation_id", chat_title("text").alias("title"))


def last_activity(messages: DataFrame, at: str = "created_at") -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.max(at).alias("updated_at"))
