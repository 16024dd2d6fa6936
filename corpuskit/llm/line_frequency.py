"""Line dedup by site-relative frequency: lines that stand on more than a given
share of a host's pages are dropped from its pages.

Counts are aggregated per (host, line) before and after the shuffle, so a host
that owns a third of all pages, or one very common line, costs one row per task.
Only numbers and 64-bit hashes of lines move; texts move once, and only where
the list of pages with dropped lines is too large to send to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_RATIO = 0.02
MIN_PAGES = 5


def url_host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and a leading `www.`."""
    authority = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(authority, r"^(?:[^@]*@)?(?:www\.)?|:\d*$", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def _marks(numbers: Column, keep: bool) -> Column:
    return F.transform(numbers, lambda i: F.struct(i.alias("line"), F.lit(keep).alias("keep")))


def boilerplate_lines(docs: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line hash, pages, host_pages, ratio) of the lines to drop.

    A line counts once a page; pages of a host with the same text count once, so
    that copies of a page do not turn it into boilerplate. Blank lines are never
    dropped. A null host is a host of its own; null texts are no pages.
    """
    pages = docs.where(F.col(text_col).isNotNull()).select(
        host.alias("host"), F.xxhash64(text_col).alias("page"), F.col(text_col).alias("text")
    )
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _has_word), lambda x: F.xxhash64(x)))).alias("line"))
    counted = lines.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    same = counted["host"].eqNullSafe(totals["host"])
    return counted.join(totals, same).select(
        counted["host"], "line", "pages", "host_pages", (F.col("pages") / F.col("host_pages")).alias("ratio")
    ).where(F.col("ratio") > max_ratio)


def drop_boilerplate(docs: DataFrame, host: Column, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """`docs` with `text` freed of boilerplate lines and `dropped_lines`, the
    numbers (from 0) of the lines that went.

    A line goes where its share of the host's distinct pages is over `max_ratio`
    and it stands on `min_pages` pages or more (a small host has no boilerplate
    to tell from content). Every row stays, repeated ones too; a text whose lines
    all go becomes empty; a null text stays null. Other columns are kept as they
    are; an input column named `dropped_lines` is replaced.
    """
    docs = docs.drop("dropped_lines")
    bad = boilerplate_lines(docs, host, text_col, max_ratio, min_pages)
    numbered = docs.where(F.col(text_col).isNotNull()).select(
        host.alias("__lf_host"), F.col(id_col).alias("__lf_id"), F.xxhash64(text_col).alias("__lf_page"),
        F.posexplode(F.transform(_lines(F.col(text_col)), lambda x: F.xxhash64(x))).alias("__lf_at", "__lf_line"),
    )
    hit = numbered.join(bad, F.col("__lf_host").eqNullSafe(bad["host"]) & (F.col("__lf_line") == bad["line"]), "left_semi")
    # Repeated rows give the same numbers, so a set per (id, text, host) serves all.
    listed = hit.groupBy("__lf_id", "__lf_page", "__lf_host").agg(F.sort_array(F.collect_set("__lf_at")).alias("__lf_dropped"))
    mine = F.col("__lf_id").eqNullSafe(F.col(id_col)) & (F.col("__lf_page") == F.xxhash64(text_col)) & F.col("__lf_host").eqNullSafe(host)
    joined = docs.join(listed, mine, "left")
    # A mark for each line, in the lines' order: linear in the lines, however many go.
    gone = F.col("__lf_dropped")
    stays = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col(text_col))) - 1), gone)
    marks = F.sort_array(F.concat(_marks(stays, True), _marks(gone, False)))
    marked = F.zip_with(_lines(F.col(text_col)), marks, lambda line, mark: F.when(mark["keep"], line))
    parts = F.filter(marked, lambda line: line.isNotNull())
    text = F.when(F.col("__lf_dropped").isNull(), F.col(text_col)).otherwise(F.array_join(parts, "\n"))
    columns = [text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.coalesce("__lf_dropped", F.array().cast("array<int>")).alias("dropped_lines"))
