"""Loading chunk records into the search table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.functions.analyzer import Analyzer
from corpuskit.functions.text import blank_to_null, empty_to_null
from corpuskit.operators.lexical import with_tokens
from corpuskit.operators.merge import upsert
from corpuskit.operators.ranking import best_rows
from corpuskit.sinks.tables import publish, read_table

LISTS = ("hierarchy", "defined_terms", "cross_refs", "internal_refs", "image_refs")
APPLICABILITY = ("building_classes", "jurisdictions", "climate_zones")


def to_rows(records: DataFrame, dataset_version: str, retrieved_at: datetime | None = None) -> DataFrame:
    """Chunk records as table rows: defaults filled in, external_refs under its
    table name standard_refs, empty applicability lists as NULL, provenance added."""

    def filled(name: str, source: str | None = None):
        source = source or name
        return F.coalesce(F.col(source), F.array().cast(records.schema[source].dataType)).alias(name)

    stamp = F.lit(retrieved_at) if retrieved_at else F.current_timestamp()
    extra = [c for c in ("file_ord", "row_ord") if c in records.columns]
    return records.select(
        "id", F.coalesce(blank_to_null("node_type"), F.lit("clause")).alias("node_type"), "clause_id", "heading", "doc",
        F.coalesce("text", F.lit("")).alias("text"),
        *[filled(name) for name in LISTS],
        filled("standard_refs", "external_refs"),
        *[empty_to_null(name).alias(name) for name in APPLICABILITY],
        "applicability_note", F.lit(dataset_version).alias("dataset_version"), stamp.alias("retrieved_at"), "embedding",
        *extra,
    )


def deduplicate(rows: DataFrame) -> DataFrame:
    """One row per id, the last one by file and place in the file."""
    return best_rows(rows, ["id"], F.struct("file_ord", "row_ord"), "last").drop("file_ord", "row_ord")


def load_summary(records: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: records read, duplicates collapsed, rows to write, with figures, with vectors."""
    read = records.agg(F.count(F.lit(1)).alias("records_read"))
    kept = unique.agg(
        F.count(F.lit(1)).alias("rows_to_write"),
        F.count_if(F.size("image_refs") > 0).alias("figures_with_refs"),
        F.count_if(F.size("embedding") > 0).alias("rows_with_embedding"),
    )
    # Two one-row tables, put side by side.
    one = F.lit(1).alias("_one")
    both = read.select("*", one).join(kept.select("*", one), "_one").drop("_one")
    return both.withColumn("duplicates_collapsed", F.col("records_read") - F.col("rows_to_write"))


def load_corpus(
    spark: SparkSession,
    records: DataFrame,
    root: str,
    dataset_version: str,
    truncate: bool = False,
    dry_run: bool = False,
    analyzer: Analyzer | None = None,
    retrieved_at: datetime | None = None,
) -> DataFrame:
    """Upserts the records into the table at `root` (or replaces it) and returns
    the summary. A dry run returns the same summary and writes nothing. With an
    analyzer the tokens are stored too, so that searches need not re-read texts.
    """
    unique = deduplicate(to_rows(records, dataset_version, retrieved_at))
    summary = load_summary(records, unique)
    if dry_run:
        return summary
    if analyzer is not None:
        unique = with_tokens(unique, analyzer)
    stored = None if truncate else read_table(spark, root)
    publish(unique if stored is None else upsert(stored, unique), root)
    return summary
