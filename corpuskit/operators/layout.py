"""Captions and figure regions from page layout tables.

Images meet captions through vertical bands: each side is keyed by (doc, page, band),
so a rectangle is compared with its neighbourhood and not with the whole page. The
artwork of figures is dealt to captions in one ordered pass over a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuskit.functions.captions import (
    FLOOR,
    alt_text_caption,
    figure_caption_number,
    horizontal_overlap,
    is_decorative,
    nearby_caption,
    paragraph_caption,
)
from corpuskit.functions.text import collapse, is_blank, safe_name
from corpuskit.operators.ranking import best_rows, top_k, union_all

# Fixed values, in points.
SEARCH_BELOW = 140
SEARCH_ABOVE = 80
MIN_OVERLAP = 0.25
MARGIN_TOP = 55
MARGIN_BOTTOM = 810
MIN_DRAWING_SIDE = 3
PAD = 8
MIN_REGION_HEIGHT = 40
MIN_REGION_WIDTH = 80
LABEL_REACH = 40
NEXT_CAPTION_GAP = 4
CAPTION_SLACK = 2

BAND = 140


def _band(y: Column) -> Column:
    return F.floor(y / BAND).cast("int")


def _bands(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(_band(low), F.greatest(_band(low), _band(high))))


def _best(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Most trusted candidate per key, the earliest (`try`) on equal trust."""
    usable = candidates.where((F.col("caption.text") != "") & (F.col("caption.confidence") >= FLOOR))
    order = F.struct((-F.col("caption.confidence")).alias("c"), F.col("try").alias("t"))
    return best_rows(usable.select(*keys, "caption", "try"), keys, order, "first").select(*keys, "caption.*")


def page_captions(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, image_id, text, source, confidence): the best caption among
    text blocks under (or, if they read like one, over) an image."""
    shots = images.select(
        "doc_id", "page", "image_id", *[F.col(c).alias(f"i{c}") for c in ("x0", "y0", "x1", "y1")]
    )
    near = shots.withColumn("band", _bands(F.col("iy0") - SEARCH_ABOVE, F.col("iy1") + SEARCH_BELOW))
    # A block is found by its top edge when below an image, by its bottom edge when above.
    texts = blocks.where((F.col("block_type") == 0) & ~is_blank("text"))
    edges = texts.select(
        "*", F.explode(F.array(F.struct(F.lit(True).alias("below"), F.col("y0").alias("edge")),
                               F.struct(F.lit(False).alias("below"), F.col("y1").alias("edge")))).alias("e")
    ).select("*", "e.*").drop("e").withColumn("band", _band(F.col("edge")))
    under = F.col("below") & (F.col("y0") >= F.col("iy1"))
    over = ~F.col("below") & (F.col("y0") < F.col("iy1")) & (F.col("y1") <= F.col("iy0"))
    gap = F.when(under, F.col("y0") - F.col("iy1")).when(over, F.col("iy0") - F.col("y1"))
    limit = F.when(F.col("below"), SEARCH_BELOW).otherwise(SEARCH_ABOVE)
    joined = near.join(edges, ["doc_id", "page", "band"]).withColumn("gap", gap)
    close = joined.where(
        (F.col("gap") <= limit) & (horizontal_overlap("ix0", "ix1", "x0", "x1") >= MIN_OVERLAP)
    )
    found = close.select(
        "doc_id", "page", "image_id", F.col("block_ord").alias("try"), nearby_caption("text", "gap", "below").alias("caption")
    )
    return _best(found, ["doc_id", "page", "image_id"])


def paragraph_captions(drawings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, rel_id, text, source, confidence): alt text, else the caption in
    the drawing's own, the next or (slightly less trusted) the previous paragraph.

    Paragraphs are numbered without gaps, so neighbours are an equi-join.
    """
    keys = ["doc_id", "para_ord", "rel_id"]
    authored = drawings.select(
        *keys, F.lit(0).alias("try"), alt_text_caption("alt", "shape_name").alias("caption")
    ).where(F.col("caption").isNotNull())
    tries = F.array(*[F.struct(F.lit(t).alias("try"), F.lit(o).alias("offset")) for t, o in ((1, 0), (2, 1), (3, -1))])
    looked = drawings.select(*keys, F.explode(tries).alias("t")).select(
        *keys, "t.*", (F.col("para_ord") + F.col("t.offset")).alias("_ord")
    )
    texts = paragraphs.select("doc_id", F.col("para_ord").alias("_ord"), "text", "style")
    caption = paragraph_caption("text", "style")
    lowered = F.struct(
        caption["text"].alias("text"), caption["source"].alias("source"),
        (caption["confidence"] - F.when(F.col("offset") == -1, 0.05).otherwise(0.0)).alias("confidence"),
    )
    nearby = (
        looked.join(texts, ["doc_id", "_ord"])
        .select(*keys, "try", F.when(caption.isNotNull(), lowered).alias("caption"))
        .where(F.col("caption").isNotNull())
    )
    return _best(union_all([authored, nearby]), keys)


def image_report(images: DataFrame, captions: DataFrame, results: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per document: found, skipped, described, failed, captioned, truncated.

    images: doc_id, image_id, image_ord, width, height, bytes. captions: doc_id,
    image_id, text. results: doc_id, image_id, ok (of the description model).
    Decorative images are skipped, then at most `cap` per document are kept.
    """
    kind = images.withColumn("decorative", is_decorative("width", "height", "bytes"))
    counts = kind.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("images_found"), F.count_if("decorative").alias("images_skipped")
    )
    real = kind.where(~F.col("decorative"))
    kept = top_k(real, ["doc_id"], [F.col("image_ord")], cap) if cap is not None else real
    outcome = (
        kept.join(captions.select("doc_id", "image_id", F.col("text").alias("caption")), ["doc_id", "image_id"], "left")
        .join(results.select("doc_id", "image_id", "ok"), ["doc_id", "image_id"], "left")
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("kept"),
            F.count_if(F.col("ok")).alias("described"),
            F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"),
            F.count_if(F.col("caption") != "").alias("captioned"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(outcome, "doc_id", "left").select(
        "doc_id", "images_found", "images_skipped", zero("described"), zero("failed"), zero("captioned"),
        (F.col("images_found") - F.col("images_skipped") > F.coalesce("kept", F.lit(0))).alias("truncated"),
    )


def figure_regions(pages: DataFrame, blocks: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, number, page, caption, file_name, x0, y0, x1, y1): the artwork
    between a figure's caption and the next caption on its page, joined with the
    labels over it. The first occurrence of a number that has artwork wins.

    A page is gone through once from top to bottom, whatever its captions and
    drawings; `y0` is a rectangle's upper edge.
    """
    page_key = ["doc_id", "page"]
    fig_key = [*page_key, "cap_ord"]
    box = ("x0", "y0", "x1", "y1")
    sides = [F.col(c).cast("double").alias(c) for c in box]
    kind, head, label, art = F.col("kind"), F.lit(0), F.lit(1), F.lit(2)
    # A caption stands among the rectangles of its page twice, as itself and as a label.
    texts = blocks.select(
        *page_key, "block_ord", *sides, (F.col("y1") - CAPTION_SLACK).cast("double").alias("top"),
        (F.col("y0") - NEXT_CAPTION_GAP).cast("double").alias("before"), figure_caption_number("text").alias("number"), collapse("text").alias("caption"),
    ).withColumn("kind", F.explode(F.when(F.col("number").isNotNull(), F.array(head, label)).otherwise(F.array(label))))
    texts = texts.withColumns({c: F.when(kind == head, F.col(c)) for c in ("top", "before", "number", "caption")})
    big = (F.col("x1") - F.col("x0") >= MIN_DRAWING_SIDE) | (F.col("y1") - F.col("y0") >= MIN_DRAWING_SIDE)
    blank = [F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("block_ord", "top", "before", "number", "caption")]
    drawn = drawings.where(big & (F.col("y0") >= MARGIN_TOP)).select(*page_key, *sides, *blank, art.alias("kind")).select(*texts.columns)
    rows = union_all([texts, drawn]).where(F.col("doc_id").isNotNull() & F.col("page").isNotNull())

    # The stretches under the captions of a page lie one after another, so a rectangle
    # can only be in that of the last caption that ends above it.
    in_turn = Window.partitionBy(*page_key).orderBy("kind", "y0", "block_ord")
    down = Window.partitionBy(*page_key).orderBy(F.coalesce("top", "y0"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    margin = F.lit(float(MARGIN_BOTTOM))
    bottom = F.when(kind == head, F.least(F.coalesce(F.lead("before").over(in_turn), margin), margin))
    stretch = F.when(F.col("top") <= F.col("bottom"), F.struct(F.col("block_ord").alias("cap_ord"), "top", "bottom"))
    placed = rows.withColumn("bottom", bottom).withColumn("under", F.last(stretch, ignorenulls=True).over(down))
    inside = (F.col("y0") >= F.col("under.top")) & (F.col("y1") <= F.col("under.bottom"))
    held = placed.where((kind == head) | inside).withColumn("cap_ord", F.when(kind == head, F.col("block_ord")).otherwise(F.col("under.cap_ord")))

    # The region widens with every label taken in, in block order, and a label
    # is taken when it lies near the region as it is then: a fold over the
    # labels of one figure, which are a part of one page.
    of = lambda which, value: F.when(kind == which, value)
    as_head = F.struct("number", "caption", *[F.col(c).alias(f"c{c}") for c in box])
    figures = (
        held.where(F.col("cap_ord").isNotNull()).groupBy(*fig_key)
        .agg(
            F.collect_list(of(head, as_head)).alias("heads"), F.count_if(kind == art).alias("drawn"),
            *[(F.min if c in ("x0", "y0") else F.max)(of(art, F.col(c))).alias(f"b{c}") for c in box],
            F.array_sort(F.collect_list(of(label, F.struct("block_ord", *box)))).alias("labels"),
        )
        .where("drawn > 0").withColumn("h", F.explode("heads")).select(*fig_key, "h.*", *[f"b{c}" for c in box], "labels")
    )
    start = F.struct(*[F.col(f"b{c}").alias(c) for c in box])

    def widen(box: Column, label: Column) -> Column:
        near = (label["x1"] >= box["x0"] - LABEL_REACH) & (label["x0"] <= box["x1"] + LABEL_REACH)
        grown = F.struct(
            F.least(box["x0"], label["x0"]).alias("x0"), F.least(box["y0"], label["y0"]).alias("y0"),
            F.greatest(box["x1"], label["x1"]).alias("x1"), F.greatest(box["y1"], label["y1"]).alias("y1"),
        )
        return F.when(near, grown).otherwise(box)

    merged = figures.withColumn("box", F.aggregate("labels", start, widen)).join(pages.select(*page_key, "width", "height"), page_key)
    clipped = merged.select(
        *fig_key, "number", "caption", "cy0",
        F.greatest(F.least("box.x0", "cx0") - PAD, F.lit(0.0)).alias("x0"),
        F.greatest(F.least("box.y0", "cy0") - PAD, F.lit(0.0)).alias("y0"),
        F.least(F.greatest("box.x1", "cx1") + PAD, F.col("width")).alias("x1"),
        F.least(F.greatest("box.y1", "cy1") + PAD, F.col("height")).alias("y1"),
    )
    sized = clipped.where(
        (F.col("y1") - F.col("y0") >= MIN_REGION_HEIGHT) & (F.col("x1") - F.col("x0") >= MIN_REGION_WIDTH)
    )
    first = best_rows(sized, ["doc_id", "number"], F.struct("page", "cy0", "cap_ord"), "first")
    name = F.concat(F.lit("figure-"), safe_name("number"), F.lit(".png"))
    return first.select("doc_id", "number", "page", "caption", name.alias("file_name"), "x0", "y0", "x1", "y1")
