"""Per-user lists, folders and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.operators.ranking import union_all


def owned_by(rows: DataFrame, user) -> DataFrame:
    """A user's own rows. A filter for convenience, not a security boundary."""
    return rows.where(F.col("user_id") == F.lit(user))


def listing(documents: DataFrame, heavy: tuple[str, ...] = ("text",)) -> DataFrame:
    """The list view: without the heavy columns, which are then never read."""
    return documents.drop(*heavy)


def title_contains(column: str, needle: str) -> Column:
    return F.contains(F.lower(column), F.lit(needle.lower()))


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    return rows.orderBy(F.col(at).desc(), key)


def feedback(rows: DataFrame, clause_id: str | None = None) -> DataFrame:
    """Newest first; a clause filter when one is given."""
    kept = rows.where(F.col("clause_id") == clause_id) if clause_id else rows
    return newest_first(kept, "created_at", "id")


def folder_counts(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Every folder with its number of documents, zero included."""
    counts = documents.groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))
    return folders.join(counts, "folder_id", "left").select(
        "folder_id", "name", F.coalesce("n", F.lit(0)).alias("documents")
    )


def grouped_documents(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Finished documents under their folder, the unfiled ones in a last group.
    A folder without finished documents has no rows. A document pointing to a
    folder that is not there is in no group."""
    done = documents.where(F.col("status") == "done")
    filed = done.join(folders.select("folder_id", F.col("name").alias("group"), "ord"), "folder_id").withColumn(
        "unfiled", F.lit(0)
    )
    loose = done.where(F.col("folder_id").isNull()).select(
        "*", F.lit("Unfiled").alias("group"), F.lit(None).cast("long").alias("ord"), F.lit(1).alias("unfiled")
    )
    return union_all([filed, loose])
