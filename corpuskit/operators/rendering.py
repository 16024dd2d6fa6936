"""Text of content blocks and tables, from the element table.

A content block is a list of lines: paragraphs, list items, section titles and
equations. Which line a piece of text belongs to can be read off its path below
the block, and whose text the block is off the path above it. So pieces go to the
owner once, and are put into lines, blocks and the owner's text where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuskit.functions.markers import list_marker
from corpuskit.functions.text import blank_to_null, collapse
from corpuskit.operators.elements import attr, inside, own_place, subtree_text, tail_place, up
from corpuskit.operators.ranking import best_rows, union_all

EQUATIONS = ("equation-inline", "equation-block")
# A line: a paragraph or a list item, below any number of titled sections.
LINE = r"^((?:section/)*(?:p|(?:ol|ul)/li(?:/(?:ol|ul)/li)*))(?:/(.*))?$"
ITEM = r"(?:ol|ul)/li"
# Children of a line that are not part of its own text.
APART = r"^(?:ol|ul|section|equation-inline|equation-block)(?:/|$)"


def equation_texts(nodes: DataFrame) -> DataFrame:
    """(corpus, pre, equation): the readable tokens, or a placeholder."""
    tokens = inside(nodes.where(F.col("tag").isin("mi", "mn", "mo") & (F.col("text") != "")), EQUATIONS)
    ordered = F.sort_array(F.collect_list(F.struct("pre", "text")))
    read = tokens.groupBy("corpus", "within").agg(F.array_join(ordered["text"], "").alias("equation"))
    marks = nodes.where(F.col("tag").isin(*EQUATIONS)).select("corpus", "pre")
    read = read.withColumnRenamed("within", "pre")
    return marks.join(read, ["corpus", "pre"], "left").select(
        "corpus", "pre", F.coalesce("equation", F.lit("[equation]")).alias("equation")
    )


def _pieces(nodes: DataFrame) -> DataFrame:
    """(corpus, pre, all, block, line, ready, head, place, fragment): text of content
    blocks by the element that owns it (`pre`). A line is numbered by its element; -1 is
    a block's number, -2 the block itself. `ready`: a line of its own as it stands."""
    lists = nodes.where(F.col("tag").isin("ol", "ul")).select(
        "corpus", F.col("pre").alias("parent"), attr("class").alias("style")
    )
    kept = ("corpus", "pre", "last", "depth", "parent", "tag", "tag_ord", "text", "tail", "tag_path", "pre_path")
    # The other elements have neither a list above nor an equation to be joined for.
    joined = F.coalesce(up("tag_path", 1).isin("ol", "ul"), F.lit(False)) | F.coalesce(F.col("tag").isin(*EQUATIONS), F.lit(False))
    below = nodes.where(F.col("tag_path").isNotNull() & F.array_contains("tag_path", "content")).select(*kept)
    formal = below.where(joined).join(lists, ["corpus", "parent"], "left").join(equation_texts(nodes), ["corpus", "pre"], "left")
    none = F.lit(None).cast("string")
    depth, place = F.size("tag_path"), F.col("at")
    above, two_up = F.get("tag_path", place - 1), F.get("tag_path", place - 2)
    of_entry = (above == "glossdef") & (two_up == "glossentry")
    of_intro = (above == "intro-part") & two_up.isin("part", "specification")
    member = (
        inside(union_all([below.where(~joined).select("*", none.alias("style"), none.alias("equation")), formal]), ("content",))
        .select(
            "corpus", F.col("within").alias("block"), "pre", "last", "depth", "tag", "tag_ord", "text", "tail", "style", "equation",
            F.when(of_entry | of_intro, F.get("pre_path", place - 2)).otherwise(F.get("pre_path", place - 1)).alias("owner"),
            F.coalesce(of_entry, F.lit(False)).alias("all"),
            F.slice("tag_path", place + 2, depth).alias("rel"),
            F.slice("pre_path", place + 2, depth).alias("rel_pre"),
        )
        .withColumn("route", F.array_join("rel", "/"))
        .withColumn("line_route", F.regexp_extract("route", LINE, 1))
        .withColumn("rest", F.regexp_extract("route", LINE, 2))
        .withColumn("above", F.when(F.col("tail") != "", F.array_join(F.slice("rel", F.lit(1), F.greatest(F.size("rel") - 1, F.lit(0))), "/")).otherwise(""))
        .withColumn("above_line", F.regexp_extract("above", LINE, 1))
        .withColumn("above_rest", F.regexp_extract("above", LINE, 2))
    )
    segments = lambda c: F.size(F.split(c, "/"))
    of_line = F.get("rel_pre", segments(F.col("line_route")) - 1)
    flows, itself = F.col("line_route") != "", F.col("block") == F.col("pre")
    level = F.size(F.regexp_extract_all("route", F.lit(ITEM), F.lit(0))) - 1
    head = F.when(flows & (F.col("rest") == ""), F.struct(F.col("tag"), F.col("tag_ord"), F.col("style"), level.alias("level")))

    def piece(line, ready, place, fragment, head=F.lit(None)):
        kind = "struct<tag:string,tag_ord:int,style:string,level:int>"
        return F.struct(line.cast("long").alias("line"), F.lit(ready).alias("ready"), place.alias("place"), fragment.alias("fragment"), head.cast(kind).alias("head"))

    text, equation = F.col("text"), F.col("equation")
    own = (
        F.when(itself, piece(F.lit(-2), True, own_place(), F.lit("")))
        .when(flows & F.col("rest").isin(*EQUATIONS), piece(of_line, False, own_place(), equation))
        .when(flows & ~F.rlike("rest", F.lit(APART)), piece(of_line, False, own_place(), text, head))
        # A titled section opens at its own place; an equation may stand on a line alone.
        .when(
            F.rlike("route", F.lit("^(?:section/)+title$")) & (F.col("tag_ord") == 0) & (text != ""),
            piece(F.get("rel_pre", F.size("rel") - 2), True, own_place(), F.concat(text, F.lit(":"))),
        )
        .when(F.rlike("route", F.lit("^(?:section/)*equation-block$")), piece(F.col("pre"), True, own_place(), equation))
        .when((F.col("route") == "num") & (F.col("tag_ord") == 0), piece(F.lit(-1), True, own_place(), text))
    )
    tail = F.when(
        ~itself & (F.col("above_line") != "") & ~F.rlike("above_rest", F.lit(APART)) & (F.col("tail") != ""),
        piece(F.get("rel_pre", segments(F.col("above_line")) - 1), False, tail_place(), F.col("tail")),
    )
    rows = member.select("corpus", F.col("owner").alias("pre"), "all", "block", F.explode(F.array(own, tail)).alias("p"))
    return rows.where(F.col("p").isNotNull()).select("corpus", "pre", "all", "block", "p.*")


def content_texts(nodes: DataFrame) -> DataFrame:
    """(corpus, pre of the owner, content_text): the rendered content an element
    owns: its first content child; for parts the first one of the introduction;
    for glossary entries all blocks of the definition."""
    pieces = _pieces(nodes).repartition("corpus", "pre")
    fragments = F.sort_array(F.collect_list(F.struct("place", "fragment")))["fragment"]
    lines = pieces.groupBy("corpus", "pre", "block", "line").agg(
        F.max("all").alias("all"), F.max("ready").alias("ready"), F.max("head").alias("h"), fragments.alias("fragments")
    )
    lines = lines.withColumn("body", F.when(~F.col("ready"), collapse(F.array_join("fragments", ""))))
    item = F.concat(
        F.repeat(F.lit("  "), F.col("h.level")), F.lit("("), list_marker("h.style", "h.tag_ord", "h.level"), F.lit(") "), F.col("body")
    )
    flowing = F.when(F.col("h.tag") == "li", item).otherwise(blank_to_null("body"))
    lines = lines.select("corpus", "pre", "all", "block", "line", F.when(F.col("ready"), F.col("fragments")).otherwise(F.array(flowing)).alias("outs"))
    listed = F.flatten(F.sort_array(F.collect_list(F.when(F.col("line") >= 0, F.struct("line", "outs"))))["outs"])
    blocks = lines.groupBy("corpus", "pre", "block").agg(
        F.max("all").alias("all"),
        F.array_join(listed, "\n").alias("body"),
        F.max(F.when(F.col("line") == -1, F.array_max("outs"))).alias("num"),
        F.max(F.when(F.col("line") == -2, F.size("outs"))).alias("copies"),
    )
    spaced = F.when(F.endswith("num", F.lit(" ")), F.col("num")).otherwise(F.concat("num", F.lit(" ")))
    prefix = F.when((F.col("num") != "") & (F.col("body") != ""), spaced).otherwise(F.lit(""))
    rendered = blocks.select("corpus", "pre", "all", "block", "copies", F.concat(prefix, F.col("body")).alias("rendered"))
    # A block that is there several times is one text, and as many of an entry's blocks.
    repeated = F.when(F.col("rendered") != "", F.array_join(F.array_repeat("rendered", F.col("copies")), "\n"))
    whole = F.sort_array(F.collect_list(F.struct("block", repeated.alias("text"))))["text"]
    return rendered.groupBy("corpus", "pre").agg(
        F.max("all").alias("all"), F.min_by("rendered", "block").alias("first"), F.array_join(whole, "\n").alias("whole")
    ).select("corpus", "pre", F.when(F.col("all"), F.col("whole")).otherwise(F.col("first")).alias("content_text"))


def _cells(nodes: DataFrame) -> DataFrame:
    """Cells of the first table of every table reference, in its first head and body."""
    placed = (
        F.col("tag").isin("th", "td") & (up("tag_path", 1) == "tr") & up("tag_path", 2).isin("thead", "tbody")
        & (up("tag_path", 3) == "table") & (up("tag_path", 4) == "table-reference")
        & (up("nth_path", 2) == 0) & (up("nth_path", 3) == 0)
    )
    cells = nodes.where(placed).select(
        "corpus", "pre", "tag", up("tag_path", 2).alias("part"), up("pre_path", 1).alias("row"), up("pre_path", 4).alias("table")
    )
    return cells.join(subtree_text(nodes.where(F.arrays_overlap("tag_path", F.array(F.lit("th"), F.lit("td")))), "th", "td"), ["corpus", "pre"])


def table_bodies(nodes: DataFrame) -> DataFrame:
    """(corpus, pre of the table reference, body): one line per row, cells joined
    by ' | ', heads first; blank cells and rows are left out."""
    cells = _cells(nodes).withColumn("value", collapse("full_text")).where(F.col("value") != "")
    in_row = F.sort_array(F.collect_list(F.struct((F.col("tag") == "td").alias("d"), "pre", "value")))
    rows = cells.groupBy("corpus", "table", "part", "row").agg(
        F.array_join(in_row["value"], " | ").alias("line")
    )
    ordered = F.sort_array(F.collect_list(F.struct((F.col("part") == "tbody").alias("b"), "row", "line")))
    return rows.groupBy("corpus", F.col("table").alias("pre")).agg(
        F.array_join(ordered["line"], "\n").alias("body")
    )


def standards_schedule(nodes: DataFrame) -> DataFrame:
    """(key, standard, date, title): body rows of the "Schedule of referenced
    documents" tables with three cells and a number; the last one of a key wins."""
    from corpuskit.functions.citations import normalise_standard
    from corpuskit.functions.text import strip
    from corpuskit.operators.elements import child_text

    titles = child_text(nodes, "title", "heading")
    schedules = titles.where(F.contains(F.lower("heading"), F.lit("schedule of referenced documents"))).select(
        "corpus", F.col("pre").alias("table")
    )
    cells = _cells(nodes).where((F.col("tag") == "td") & (F.col("part") == "tbody"))
    in_row = F.sort_array(F.collect_list(F.struct("pre", strip("full_text").alias("v"))))
    order = nodes.select("corpus", "corpus_ord").distinct()
    rows = (
        cells.join(schedules, ["corpus", "table"], "left_semi")
        .groupBy("corpus", "row")
        .agg(in_row["v"].alias("c"))
        .where((F.size("c") >= 3) & (F.get("c", 0) != ""))
        .join(order, "corpus")
        .select(
            normalise_standard(F.get("c", 0)).alias("key"), F.get("c", 0).alias("standard"),
            blank_to_null(F.get("c", 1)).alias("date"), blank_to_null(F.get("c", 2)).alias("title"),
            F.struct("corpus_ord", "row").alias("at"),
        )
    )
    return best_rows(rows, ["key"], F.col("at"), "last").drop("at")
