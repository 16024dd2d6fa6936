"""Caption grammar and caption confidence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuskit.functions.text import NOT_BLANK, WHITESPACE, _c, collapse, strip

# Fixed pattern: groups are kind, number, qualifier, separator, title.
CAPTION = (
    rf"(?i)^{WHITESPACE}*"
    r"(figure|fig\.?|table|diagram|drawing|detail|photo|image|plate|sketch|appendix)"
    rf"{WHITESPACE}*"
    r"((?=[A-Za-z0-9.\-]*\d)[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)?"
    rf"(?:{WHITESPACE}*\(([^)]{{0,40}})\))?"
    rf"{WHITESPACE}*"
    rf"([:.–—-]{WHITESPACE}*)?"
    r"(.*)$"
)
PARTS = ("kind", "number", "qualifier", "sep", "title")

# Limits, and how far each way of finding a caption is trusted.
MAX_CAPTION = 300
CAPTION_STYLES = ("caption", "figurecaption", "tablecaption", "imagecaption")
ALT_TEXT, STYLED, PATTERNED, NEARBY = 0.95, 0.9, 0.75, 0.4
FLOOR = 0.4
FAR_PATTERN = 120
SNUG_TEXT = 40
PLACEHOLDER = rf"(?i)^(picture|image|graphic|shape|chart|diagram){WHITESPACE}*\d*$"
PLACEHOLDER_FILE = rf"(?i)^{NOT_BLANK}+\.(png|jpe?g|gif|bmp|tiff?|emf|wmf|svg)$"

CANDIDATE = "struct<text:string,source:string,confidence:double>"


def caption_parts(text: Column | str) -> Column:
    """The five caption groups ('' where absent); all '' when there is no match."""
    # One search: the groups are set behind a mark that no caption holds.
    marked = F.regexp_replace(strip(text), CAPTION, "\u0001$1\u0001$2\u0001$3\u0001$4\u0001$5")
    parts = F.split(F.when(F.startswith(marked, F.lit("\u0001")), marked).otherwise(F.lit("")), "\u0001")
    return F.struct(*[F.coalesce(F.get(parts, i + 1), F.lit("")).alias(p) for i, p in enumerate(PARTS)])


def looks_like_caption(text: Column | str) -> Column:
    text = _c(text)
    parts = caption_parts(text)
    short = (F.length(text) > 0) & (F.length(text) <= MAX_CAPTION)
    labelled = (parts["number"] != "") | (parts["sep"] != "") | (parts["title"] == "")
    return F.coalesce(short & (parts["kind"] != "") & labelled, F.lit(False))


def is_figure_caption(text: Column | str) -> Column:
    """A caption of a figure: numbered, and set off by a separator or qualifier."""
    text = collapse(text)
    parts = caption_parts(text)
    # An empty qualifier "()" is still a qualifier only when it holds something.
    marked = (parts["sep"] != "") | (parts["qualifier"] != "")
    kind = F.regexp_replace(F.lower(parts["kind"]), r"\.+$", "")
    return F.coalesce(kind.isin("figure", "fig") & (parts["number"] != "") & marked, F.lit(False))


def figure_caption_number(text: Column | str) -> Column:
    return F.when(is_figure_caption(text), caption_parts(collapse(text))["number"])


def candidate(text: Column, source, confidence) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(text.alias("text"), source.alias("source"), confidence.alias("confidence"))


def _sized(text: Column) -> Column:
    return (text != "") & (F.length(text) <= MAX_CAPTION)


def alt_text_caption(alt: Column | str, shape_name: Column | str) -> Column:
    """Authored alt text, else the shape's name; generated placeholders are refused."""

    def usable(value: Column) -> Column:
        value = collapse(value)
        refused = F.rlike(value, F.lit(PLACEHOLDER)) | F.rlike(value, F.lit(PLACEHOLDER_FILE))
        return F.when(_sized(value) & ~refused, value)

    chosen = F.coalesce(usable(_c(alt)), usable(_c(shape_name)))
    return F.when(chosen.isNotNull(), candidate(chosen, "alt-text", ALT_TEXT))


def paragraph_caption(text: Column | str, style: Column | str) -> Column:
    """A caption-styled paragraph, or one that reads like a caption."""
    text = collapse(text)
    name = F.regexp_replace(F.lower(F.coalesce(_c(style), F.lit(""))), "[^a-z]", "")
    return F.when(
        _sized(text),
        F.when(name.isin(*CAPTION_STYLES), candidate(text, "caption-style", STYLED)).when(
            looks_like_caption(text), candidate(text, "caption-pattern", PATTERNED)
        ),
    )


def nearby_caption(text: Column | str, distance: Column | str, below: Column | str) -> Column:
    """A text block near an image. Above it, or further than a snug gap, the
    block must read like a caption; a far one keeps only the lowest trust."""
    text, distance, below = collapse(text), _c(distance), _c(below)
    near = F.when(distance <= FAR_PATTERN, F.lit(PATTERNED)).otherwise(F.lit(NEARBY))
    return F.when(
        _sized(text),
        F.when(looks_like_caption(text), candidate(text, "caption-pattern", near)).when(
            below & (distance <= SNUG_TEXT), candidate(text, "nearby-text", NEARBY)
        ),
    )


def horizontal_overlap(ix0, ix1, bx0, bx1) -> Column:
    """Share of the image's width that a block spans."""
    ix0, ix1, bx0, bx1 = map(_c, (ix0, ix1, bx0, bx1))
    shared = F.least(ix1, bx1) - F.greatest(ix0, bx0)
    return F.when((shared > 0) & (ix1 > ix0), shared / (ix1 - ix0)).otherwise(F.lit(0.0))


def is_decorative(width: Column | str, height: Column | str, size: Column | str) -> Column:
    """Logos and glyphs: short side under 200 pixels when known, or under 8 KB."""
    width, height = _c(width), _c(height)
    small_side = (width > 0) & (height > 0) & (F.least(width, height) < 200)
    return F.coalesce(small_side, F.lit(False)) | (_c(size) < 8 * 1024)
