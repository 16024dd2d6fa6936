"""Lookups on the element table, all as equi-joins on (corpus, pre).

Every element carries the tags and numbers of its ancestors, so "inside",
"child of" and "first of its kind" are tests on arrays, not recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions.text import blank_to_null, spaced_label

LABELLED = ("ncc-section", "part", "specification")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def up(path: str, steps: int) -> Column:
    """Entry `steps` above the element itself (0 = itself), NULL above the root."""
    return F.get(F.col(path), F.size(path) - 1 - steps)


def inside(nodes: DataFrame, tags: tuple[str, ...], itself: bool = True) -> DataFrame:
    """nodes x their enclosing elements with one of the tags: adds `at`, the
    place of the enclosing element in the path, and `within`, its number."""
    last = F.size("tag_path") - (0 if itself else 1)
    places = F.filter(
        F.sequence(F.lit(0), F.size("tag_path") - 1),
        lambda i: (i < last) & F.get("tag_path", i).isin(*tags),
    )
    # Most elements have no such ancestor: a plain overlap leaves them out before their paths are walked.
    below = nodes.where(F.arrays_overlap("tag_path", F.array(*[F.lit(t) for t in tags])))
    return below.select("*", F.explode(places).alias("at")).withColumn("within", F.get("pre_path", F.col("at")))


def joined_fragments(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Concatenates `fragment` in document order (`place`) per key."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "fragment")))
    return rows.groupBy(*keys).agg(F.array_join(ordered["fragment"], "").alias(name))


def own_place() -> Column:
    return F.struct(F.col("pre").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))


def tail_place() -> Column:
    """A tail follows the whole subtree; of two ending together the inner comes first."""
    return F.struct(F.col("last").alias("a"), F.lit(1).alias("b"), (-F.col("depth")).alias("c"))


def subtree_text(nodes: DataFrame, *tags: str) -> DataFrame:
    """(corpus, pre, full_text): all text inside the elements with these tags."""
    member = inside(nodes, tags)
    parts = F.array(
        F.struct(own_place().alias("place"), F.col("text").alias("fragment")),
        F.struct(tail_place().alias("place"), F.when(F.col("pre") != F.col("within"), F.col("tail")).alias("fragment")),
    )
    rows = member.select("corpus", F.col("within").alias("pre"), F.inline(parts)).where(F.col("fragment").isNotNull())
    return joined_fragments(rows, ["corpus", "pre"], "full_text")


def child_text(nodes: DataFrame, tag: str, name: str) -> DataFrame:
    """(corpus, pre of the parent, name): own text of the first child with this tag."""
    first = nodes.where((F.col("tag") == tag) & (F.col("tag_ord") == 0) & F.col("parent").isNotNull())
    return first.select("corpus", F.col("parent").alias("pre"), F.col("text").alias(name))


def child_attr(nodes: DataFrame, tag: str, attribute: str, name: str) -> DataFrame:
    first = nodes.where((F.col("tag") == tag) & (F.col("tag_ord") == 0) & F.col("parent").isNotNull())
    return first.select("corpus", F.col("parent").alias("pre"), attr(attribute).alias(name))


def hierarchy(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """(corpus, pre, path): doc label, then the labels of the enclosing sections,
    parts and specifications, outermost first.

    anchors: the element rows to label.
    """
    titles = child_text(nodes, "title", "title")
    labelled = nodes.where(F.col("tag").isin(*LABELLED)).join(titles, ["corpus", "pre"], "left")
    labels = labelled.select(
        "corpus", F.col("pre").alias("within"), spaced_label(attr("num"), "title").alias("label")
    ).where(F.col("label").isNotNull())
    above = inside(anchors.select("corpus", "pre", "tag_path", "pre_path"), LABELLED, itself=False)
    ordered = F.sort_array(F.collect_list(F.struct("at", "label")))
    paths = above.join(labels, ["corpus", "within"]).groupBy("corpus", "pre").agg(
        ordered["label"].alias("labels")
    )
    joined = anchors.select("corpus", "pre", "doc_label").join(paths, ["corpus", "pre"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "corpus", "pre", F.concat(F.array("doc_label"), F.coalesce("labels", none)).alias("path")
    )


def guid_index(nodes: DataFrame) -> DataFrame:
    return nodes.where(blank_to_null("node_id").isNotNull())
