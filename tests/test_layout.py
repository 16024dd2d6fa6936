"""Captions and figure regions on hand-made pages."""

import pytest

from corpuskit.operators.layout import figure_regions, image_report
from corpuskit.plans.figures import match_captions

BLOCK = "doc_id int, page int, block_ord int, x0 double, y0 double, x1 double, y1 double, text string, block_type int"
IMAGE = "doc_id int, page int, image_id string, x0 double, y0 double, x1 double, y1 double"


def caption_of(spark, *blocks):
    images = spark.createDataFrame([(1, 1, "i", 100.0, 200.0, 300.0, 400.0)], IMAGE)
    rows = [(1, 1, n, *box, text, kind) for n, (box, text, kind) in enumerate(blocks)]
    got = match_captions(images, spark.createDataFrame(rows, BLOCK)).collect()
    return [(r["text"], r["source"], r["confidence"]) for r in got]


def test_caption_below_beats_snug_text(spark):
    assert caption_of(
        spark, ((100.0, 410.0, 300.0, 420.0), "Loose words", 0), ((100.0, 425.0, 300.0, 440.0), "Figure 3:  Wall", 0)
    ) == [("Figure 3: Wall", "caption-pattern", 0.75)]


@pytest.mark.parametrize(
    ("box", "text", "kind", "want"),
    [
        ((100.0, 180.0, 300.0, 190.0), "Figure 1", 0, [("Figure 1", "caption-pattern", 0.75)]),
        ((100.0, 180.0, 300.0, 190.0), "Some words", 0, []),  # above, and not caption-shaped
        ((100.0, 450.0, 300.0, 460.0), "Some words", 0, []),  # below, but not snug
        ((100.0, 430.0, 300.0, 440.0), "Some words", 0, [("Some words", "nearby-text", 0.4)]),
        ((100.0, 530.0, 300.0, 540.0), "Figure 1", 0, [("Figure 1", "caption-pattern", 0.4)]),  # far: least trust
        ((100.0, 545.0, 300.0, 550.0), "Figure 1", 0, []),  # out of reach
        ((280.0, 410.0, 400.0, 420.0), "Figure 1", 0, []),  # next column
        ((100.0, 410.0, 300.0, 420.0), "Figure 1", 1, []),  # an image block
        ((100.0, 300.0, 300.0, 310.0), "Figure 1", 0, []),  # a label on the image
    ],
)
def test_caption_reach(spark, box, text, kind, want):
    assert caption_of(spark, (box, text, kind)) == want


def test_paragraph_captions(spark):
    paragraphs = spark.createDataFrame(
        [(1, 0, "Figure 1: above", None), (1, 1, " ", None), (1, 2, "Styled", "Caption"), (1, 3, "prose", None), (1, 4, "", None),
         (1, 5, "Figures are indicative", None), (1, 6, "Figure 9: before", None), (1, 7, "", None)],
        "doc_id int, para_ord int, text string, style string",
    )
    drawings = spark.createDataFrame(
        [(1, 1, "r1", None, "Picture 3"), (1, 1, "r2", "A drawn wall", None), (1, 4, "r3", None, "image1.png"), (1, 7, "r4", None, None)],
        "doc_id int, para_ord int, rel_id string, alt string, shape_name string",
    )
    got = {r["image_id"]: (r["text"], r["source"], round(r["confidence"], 2)) for r in match_captions(drawings=drawings, paragraphs=paragraphs).collect()}
    assert got == {
        "r1": ("Styled", "caption-style", 0.9), "r2": ("A drawn wall", "alt-text", 0.95), "r4": ("Figure 9: before", "caption-pattern", 0.7),
    }


def test_image_report(spark):
    images = spark.createDataFrame(
        [(1, f"i{n}", n, 400, 400, 90_000) for n in range(4)] + [(1, "logo", 9, 50, 400, 90_000), (1, "tiny", 10, None, None, 100), (2, "x", 0, 10, 10, 5)],
        "doc_id int, image_id string, image_ord int, width int, height int, bytes int",
    )
    captions = spark.createDataFrame([(1, "i0", "Figure 1"), (1, "i3", "Figure 4")], "doc_id int, image_id string, text string")
    results = spark.createDataFrame([(1, "i0", True), (1, "i1", False), (1, "i2", True)], "doc_id int, image_id string, ok boolean")
    rows = {r["doc_id"]: tuple(r)[1:] for r in image_report(images, captions, results, cap=3).collect()}
    assert rows == {1: (6, 2, 2, 1, 1, True), 2: (1, 1, 0, 0, 0, False)}


def test_figure_regions(spark):
    pages = spark.createDataFrame([(1, 1, 600.0, 842.0), (1, 2, 600.0, 842.0)], "doc_id int, page int, width double, height double")
    blocks = spark.createDataFrame(
        [
            (1, 1, 0, 100.0, 100.0, 300.0, 112.0, "Figure 1: First", 0),
            (1, 1, 1, 260.0, 150.0, 330.0, 160.0, "label", 0),
            (1, 1, 2, 360.0, 170.0, 380.0, 180.0, "near once the region has grown", 0),
            (1, 1, 3, 500.0, 170.0, 520.0, 180.0, "far label", 0),
            (1, 1, 4, 100.0, 400.0, 300.0, 412.0, "Figure 2 (notes) Second", 0),
            (1, 1, 5, 100.0, 430.0, 300.0, 440.0, "See Figure 7 for more", 0),
            (1, 2, 0, 100.0, 100.0, 300.0, 112.0, "Figure 1: Reprint", 0),
            (1, 2, 1, 100.0, 300.0, 300.0, 312.0, "Figure 2: Continued", 0),
        ],
        BLOCK,
    )
    drawings = spark.createDataFrame(
        [
            (1, 1, 110.0, 120.0, 250.0, 300.0), (1, 1, 120.0, 50.0, 500.0, 50.5), (1, 1, 130.0, 140.0, 131.0, 141.0),
            (1, 2, 100.0, 120.0, 250.0, 280.0), (1, 2, 100.0, 320.0, 250.0, 500.0),
        ],
        "doc_id int, page int, x0 double, y0 double, x1 double, y1 double",
    )
    got = {r["number"]: (r["page"], r["file_name"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in figure_regions(pages, blocks, drawings).collect()}
    assert got == {
        "1": (1, "figure-1.png", 92.0, 92.0, 388.0, 308.0),
        "2": (2, "figure-2.png", 92.0, 292.0, 308.0, 508.0),  # no artwork under the first one
    }


def test_figure_regions_go_through_a_page_once(spark):
    """Many captions on a page: every drawing meets one of them, and no join or
    repetition of captions stands between a page's rows and its figures."""
    from pyspark.sql import functions as F

    pages = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.lit(500.0).alias("width"), F.lit(842.0).alias("height"))
    caps = spark.range(7).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("block_ord"), F.format_string("Figure %d: view", F.col("id")).alias("text"),
        F.lit(60.0).alias("x0"), (F.col("id") * 100 + 60.0).alias("y0"), F.lit(200.0).alias("x1"), (F.col("id") * 100 + 70.0).alias("y1"),
    )
    art = spark.range(700).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.lit(70.0).alias("x0"), (F.col("id") % 7 * 100 + 75.0).alias("y0"),
        F.lit(250.0).alias("x1"), (F.col("id") % 7 * 100 + 130.0 + F.col("id") / 700).alias("y1"),
    )
    got = figure_regions(pages, caps, art)
    high = {r["number"]: (r["y0"], r["y1"]) for r in got.collect()}
    assert high == {str(i): (i * 100 + 52.0, i * 100 + 138.0 + (693 + i) / 700) for i in range(7)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "sequence(" not in plan
