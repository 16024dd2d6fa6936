"""Captions for the images of documents, and the figures of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpuskit.operators.layout import figure_regions, image_report, page_captions, paragraph_captions
from corpuskit.operators.ranking import union_all


def match_captions(
    page_images: DataFrame | None = None,
    page_blocks: DataFrame | None = None,
    drawings: DataFrame | None = None,
    paragraphs: DataFrame | None = None,
) -> DataFrame:
    """(doc_id, image_id, text, source, confidence) from page layouts, paragraph
    streams, or both."""
    found = []
    if page_images is not None and page_blocks is not None:
        found.append(page_captions(page_images, page_blocks).select("doc_id", "image_id", "text", "source", "confidence"))
    if drawings is not None and paragraphs is not None:
        by_text = paragraph_captions(drawings, paragraphs).withColumnRenamed("rel_id", "image_id")
        found.append(by_text.select("doc_id", "image_id", "text", "source", "confidence"))
    if not found:
        raise ValueError("page layouts or paragraphs are needed")
    return union_all(found)


__all__ = ["match_captions", "image_report", "figure_regions"]
