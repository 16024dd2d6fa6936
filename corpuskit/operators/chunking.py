"""Citable chunks from the element table: one builder per kind of element, their
results united in a fixed order (`builder`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions.text import (
    blank_to_null,
    building_classes,
    climate_zones,
    figure_text,
    guid_to_id,
    numbered_heading,
    one_jurisdiction,
    spaced_label,
    strip,
)
from corpuskit.operators.elements import attr, child_attr, child_text, hierarchy, up
from corpuskit.operators.ranking import union_all
from corpuskit.operators.rendering import content_texts, table_bodies
from corpuskit.sources.files import describe

CLAUSE_LIKE = ("clause", "clause-variation")
CLAUSE_PARTS = ("subclause", "subclause-variation", "callout", "clause-variation")

COLUMNS = [
    "corpus", "pre", "builder", "id", "node_type", "clause_id", "hierarchy", "heading", "doc", "text",
    "building_classes", "jurisdictions", "climate_zones", "applicability_note",
]


def _strings() -> Column:
    return F.array().cast("array<string>")


def _integers() -> Column:
    return F.array().cast("array<int>")


def _chunk(df: DataFrame, builder: Column, **values: Column) -> DataFrame:
    defaults = {
        "clause_id": F.lit(None).cast("string"),
        "building_classes": _strings(),
        "jurisdictions": F.lit(None).cast("array<string>"),
        "climate_zones": _integers(),
        "applicability_note": F.lit(None).cast("string"),
    }
    values = {**defaults, **values}
    made = df.select(
        "corpus", "pre", builder.cast("int").alias("builder"), guid_to_id(F.coalesce("node_id", F.lit(""))).alias("id"),
        F.col("doc_label").alias("doc"), *[v.alias(k) for k, v in values.items()],
    )
    return made.select(*COLUMNS)


def clause_anchors(nodes: DataFrame) -> DataFrame:
    """Elements that become a chunk of a clause, with `clause`, the number of the
    clause or variation they belong to. Every variation is met once, wherever it
    stands; a clause becomes a chunk itself only when it has no parts."""
    parent, grandparent = up("tag_path", 1), up("tag_path", 2)
    direct = parent.isin(*CLAUSE_LIKE)
    nested = (F.col("tag") == "subclause-variation") & (parent == "subclause") & grandparent.isin(*CLAUSE_LIKE)
    parts = nodes.where(
        F.col("tag").isin("subclause", "subclause-variation", "callout") & (direct | F.coalesce(nested, F.lit(False)))
    ).withColumn("clause", F.when(direct, up("pre_path", 1)).otherwise(up("pre_path", 2)))
    filled = nodes.where(F.col("tag").isin(*CLAUSE_PARTS) & direct).select("corpus", F.col("parent").alias("pre"))
    bare = (
        nodes.where(F.col("tag").isin(*CLAUSE_LIKE))
        .join(filled, ["corpus", "pre"], "left_anti")
        .withColumn("clause", F.col("pre"))
    )
    return union_all([parts, bare])


def _clauses(nodes: DataFrame) -> DataFrame:
    """(corpus, clause, sptc, title, classes, zones, override, base)."""
    clauses = nodes.where(F.col("tag").isin(*CLAUSE_LIKE))
    joined = (
        clauses.join(child_text(nodes, "sptc", "sptc_text"), ["corpus", "pre"], "left")
        .join(child_text(nodes, "title", "title"), ["corpus", "pre"], "left")
        .join(hierarchy(nodes, clauses), ["corpus", "pre"])
        .withColumn("sptc", blank_to_null(strip(F.coalesce(blank_to_null("sptc_text"), attr("sptc")))))
    )
    return joined.select(
        "corpus", F.col("pre").alias("clause"), "sptc", "title",
        building_classes(attr("building")).alias("classes"), climate_zones(attr("climate")).alias("zones"),
        F.when(F.col("tag") == "clause-variation", blank_to_null(attr("state"))).alias("override"),
        F.concat("path", F.when(F.col("sptc").isNotNull(), F.array("sptc")).otherwise(_strings())).alias("base"),
    )


def clause_chunks(nodes: DataFrame) -> DataFrame:
    anchors = clause_anchors(nodes).join(_clauses(nodes), ["corpus", "clause"])
    is_note = F.col("tag") == "callout"
    is_part = F.col("tag").isin("subclause", "subclause-variation")
    num = blank_to_null(strip(attr("num")))
    step = F.when(F.col("sptc").isNotNull(), F.concat("sptc", F.lit("("), num, F.lit(")"))).otherwise(num)
    numbered = F.when(is_part & num.isNotNull(), F.array(step)).otherwise(_strings())
    kind = blank_to_null(attr("callout-type"))
    note_heading = F.coalesce(F.concat(F.lit("Note ("), kind, F.lit(")")), F.lit("Note"))
    whole_type = F.when(F.col("override").isNotNull(), "note").otherwise("clause")
    return _chunk(
        anchors,
        F.lit(0),
        node_type=F.when(is_note, "note").when(is_part, "subclause").otherwise(whole_type),
        clause_id=F.col("sptc"),
        hierarchy=F.concat("base", numbered),
        heading=F.when(is_note, note_heading).when(is_part, F.coalesce(blank_to_null(attr("title")), F.col("title"))).otherwise(F.col("title")),
        text=F.lit(""),
        building_classes=F.when(is_note, _strings()).otherwise(F.col("classes")),
        climate_zones=F.when(is_note, _integers()).otherwise(F.col("zones")),
        jurisdictions=F.when(is_part, one_jurisdiction(attr("state"), "override")).otherwise(one_jurisdiction("override")),
    )


def _standalone(nodes: DataFrame, *tags: str) -> DataFrame:
    rows = nodes.where(F.col("tag").isin(*tags))
    return rows.join(hierarchy(nodes, rows), ["corpus", "pre"]).join(child_text(nodes, "title", "title"), ["corpus", "pre"], "left")


def part_variation_chunks(nodes: DataFrame) -> DataFrame:
    rows = _standalone(nodes, "part-variation")
    state = F.coalesce(attr("state"), F.lit("None"))
    label = F.coalesce(F.concat(F.lit("Part "), blank_to_null(attr("num"))), F.lit("Part"))
    return _chunk(
        rows, F.lit(2), node_type=F.lit("note"), clause_id=attr("num"), hierarchy=F.col("path"),
        heading=F.concat(label, F.lit(" variation ("), state, F.lit(")")), text=F.lit(""),
        jurisdictions=one_jurisdiction(attr("state")), applicability_note=attr("type"),
    )


def table_chunks(nodes: DataFrame) -> DataFrame:
    rows = _standalone(nodes, "table-reference").join(table_bodies(nodes), ["corpus", "pre"], "left")
    title, body = blank_to_null("title"), blank_to_null("body")
    return _chunk(
        rows, F.lit(3), node_type=F.lit("table"), clause_id=blank_to_null(attr("sptc")), hierarchy=F.col("path"),
        heading=numbered_heading("Table", attr("num"), "title"),
        text=F.concat_ws("\n", title, body),
    )


def figures(nodes: DataFrame, images: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Image references with src, whether the file is there, and its description.

    images: corpus, filename. descriptions: see `sources.files.description_additions`.
    """
    rows = _standalone(nodes, "image-reference").join(child_attr(nodes, "img", "src", "src"), ["corpus", "pre"], "left")
    present = images.select("corpus", F.col("filename").alias("src"), F.lit(True).alias("present")).distinct()
    found = rows.join(present, ["corpus", "src"], "left").withColumn("matched", F.coalesce("present", F.lit(False))).drop("present")
    if descriptions is None:
        return found.withColumn("description", F.lit(None).cast("string"))
    described = describe(found, "src", descriptions)
    return described.withColumn("description", F.when(F.col("matched"), F.col("description")))


def figure_heading() -> Column:
    return numbered_heading("Figure", attr("num"), "title")


def figure_chunks(figure_rows: DataFrame) -> DataFrame:
    return _chunk(
        figure_rows, F.lit(4), node_type=F.lit("figure"), hierarchy=F.col("path"), heading=figure_heading(),
        text=figure_text(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))),
    )


def part_chunks(nodes: DataFrame) -> DataFrame:
    rows = _standalone(nodes, "part", "specification")
    part = F.col("tag") == "part"
    return _chunk(
        rows, F.when(part, 5).otherwise(6), node_type=F.col("tag"), clause_id=attr("num"), hierarchy=F.col("path"),
        heading=spaced_label(attr("num"), "title"), text=F.coalesce("title", F.lit("")),
        jurisdictions=one_jurisdiction(attr("state")),
    )


def glossary_chunks(nodes: DataFrame) -> DataFrame:
    rows = nodes.where(F.col("tag") == "glossentry")
    joined = rows.join(hierarchy(nodes, rows), ["corpus", "pre"]).join(child_text(nodes, "glossterm", "term"), ["corpus", "pre"], "left")
    return _chunk(
        joined, F.lit(7), node_type=F.lit("glossary"), hierarchy=F.col("path"), heading=F.col("term"),
        text=F.lit(""),
    )


def build_chunks(nodes: DataFrame, images: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """All chunks of all documents, without references, keyed by (corpus, pre).

    `nodes` is read by many joins: pass a stored table. The rendered texts of four
    builders are joined to their chunks at once; `text` is what stands in for none.
    """
    written = union_all([clause_chunks(nodes), part_variation_chunks(nodes), part_chunks(nodes), glossary_chunks(nodes)])
    written = written.join(content_texts(nodes), ["corpus", "pre"], "left").withColumn("text", F.coalesce("content_text", "text"))
    return union_all([written.select(*COLUMNS), table_chunks(nodes), figure_chunks(figures(nodes, images, descriptions))])
