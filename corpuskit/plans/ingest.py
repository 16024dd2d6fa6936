"""Structured documents to chunks, references and a validation report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.operators import quality
from corpuskit.operators.chunking import build_chunks, figures
from corpuskit.operators.references import build_references, nest_references
from corpuskit.session import stored
from corpuskit.sources.structured import scan_documents


def ingest_documents(
    spark: SparkSession,
    corpora: DataFrame,
    paths: list[str],
    images: DataFrame,
    cited_corpus: str,
    descriptions: DataFrame | None = None,
    strict: bool = False,
):
    """(chunks, edges, report). corpora: corpus, doc_label, path, corpus_ord;
    images: corpus, filename of the image files present.

    The element table is read by many joins, so it is stored once.
    """
    nodes = stored(scan_documents(spark, corpora, paths))
    bare = stored(build_chunks(nodes, images, descriptions))
    edges = stored(build_references(nodes, bare, images, cited_corpus, strict=strict))
    drawn = figures(nodes, images, descriptions)
    described = drawn.where(F.col("description").isNotNull())
    chunks = nest_references(bare, edges, described)
    return chunks, edges, ingest_report(bare, edges, drawn)


def image_coverage(drawn: DataFrame) -> DataFrame:
    """One row: images found and missing, described and not."""
    described = F.col("description").isNotNull()
    return drawn.agg(
        F.count_if("matched").alias("images_matched"),
        F.count_if(~F.col("matched")).alias("images_unmatched"),
        F.count_if(described).alias("figures_described"),
        F.count_if(F.col("matched") & ~described).alias("figures_undescribed"),
    )


def image_gaps(drawn: DataFrame) -> DataFrame:
    """(gap, name): every image that is missing and every figure without a description."""
    gap = F.when(~F.col("matched"), "unmatched").when(F.col("description").isNull(), "undescribed")
    return drawn.select(gap.alias("gap"), F.coalesce("src", "node_id").alias("name")).where(F.col("gap").isNotNull())


def ingest_report(chunks: DataFrame, edges: DataFrame, drawn: DataFrame) -> DataFrame:
    """(section, body): the validation report, one JSON body per line."""
    external = edges.where(F.col("list") == "external_refs")
    standards = external.where(F.col("kind") == "standard").select(
        F.col("standard").alias("mention"), F.when(F.col("matched"), F.col("standard")).alias("standard")
    )
    prose = external.where(F.col("ord.a") == 2)
    return quality.report(
        {
            "node_types": quality.node_type_counts(chunks),
            "clauses": quality.clauses_per_doc(chunks),
            "images": image_coverage(drawn),
            "image_gaps": image_gaps(drawn),
            "standards": quality.standards_coverage(standards),
            "standards_unmatched": quality.unmatched_standards(standards),
            "internal_refs": quality.resolution(edges.where(F.col("list") == "internal_refs")),
            "external_refs": quality.resolution_by_kind(external),
            "prose_citations": quality.resolution(prose),
        }
    )
