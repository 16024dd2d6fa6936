"""Links between chunks: extraction, classification and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions.citations import normalise_standard, prose_citations, standard_mentions
from corpuskit.functions.text import blank_to_null, guid_to_id, strip
from corpuskit.operators.chunking import CLAUSE_LIKE, clause_anchors, figure_heading
from corpuskit.operators.elements import attr, child_attr, child_text, guid_index, inside, subtree_text
from corpuskit.operators.ranking import best_rows, union_all
from corpuskit.session import stored

# Fixed values.
CLAUSE_LINK_TYPES = ("clause", "ncc-clause", "subclause", "part", "specification", "table-reference")
DIRECT_TAGS = (
    "subclause", "subclause-variation", "table-reference", "image-reference", "glossentry", "part",
    "specification", "callout", "part-variation",
)
CITED_TAGS = (("part", "part"), ("clause", "clause"), ("table-reference", "table"), ("image-reference", "figure"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, raw_text) of every <a href> in HTML pages; links
    without text are left out."""
    pattern = F.lit(r'(?i)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>')
    group = lambda i: F.regexp_extract_all("html", pattern, F.lit(i))
    links = F.arrays_zip(group(1).alias("href"), group(2).alias("inner"))
    rows = pages.select("page_id", F.posexplode(links).alias("pos", "l"))
    text = strip(F.regexp_replace("l.inner", "<[^>]*>", ""))
    return rows.select("page_id", "pos", F.col("l.href").alias("href"), text.alias("raw_text")).where(F.col("raw_text") != "")


def links(nodes: DataFrame) -> DataFrame:
    """(corpus, pre, guid, raw_text, type, declared, publishing_id): links to elements.
    `declared` is the publishing id of another document, NULL for local links."""
    anchors = nodes.where((F.col("tag") == "a") & F.startswith(F.coalesce(attr("href"), F.lit("")), F.lit("#")))
    texts = subtree_text(nodes.where(F.array_contains("tag_path", "a")), "a")
    declared = blank_to_null(attr("publishing-id"))
    other = F.when(~declared.eqNullSafe(F.col("publishing_id")), declared)
    return (
        anchors.join(texts, ["corpus", "pre"])
        .select(
            "corpus", "pre", "pre_path", "tag_path", F.substr(attr("href"), F.lit(2)).alias("guid"), strip("full_text").alias("raw_text"),
            attr("type").alias("type"), other.alias("declared"),
        )
        .where(F.col("raw_text") != "")
    )


def resolve_links(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds t_corpus and t_pre: the link's target in the declared document, else
    in its own corpus, else in the first corpus that has it.

    found: corpus, guid, declared. targets: corpus, publishing_id, corpus_ord,
    node_id, pre. An id shared by many documents is reduced to one row per key
    before each of the three joins, so it never multiplies the links.
    """
    def lookup(name: str, **keys: Column) -> DataFrame:
        rows = targets.select(
            F.col("node_id").alias("guid"), *[c.alias(k) for k, c in keys.items()],
            F.struct("corpus", "pre").alias(name), F.struct("corpus_ord", "pre").alias("_at"),
        )
        return best_rows(rows, ["guid", *keys], F.col("_at"), "first").drop("_at")

    hit = F.coalesce("_declared", "_own", "_any")
    return (
        found.join(lookup("_declared", declared=F.col("publishing_id")), ["guid", "declared"], "left")
        .join(lookup("_own", corpus=F.col("corpus")), ["guid", "corpus"], "left")
        .join(lookup("_any"), "guid", "left")
        .withColumn("t_corpus", hit["corpus"])
        .withColumn("t_pre", hit["pre"])
        .drop("_declared", "_own", "_any")
    )


def classified_links(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """Links with their kind and what that kind needs from the target.

    kind: term, image, external, internal or plain.
    """
    targets = guid_index(nodes)
    resolved = resolve_links(links(nodes), targets)
    terms = child_text(nodes, "glossterm", "term").join(
        targets.where(F.col("tag") == "glossentry").select("corpus", "pre", "node_id", "corpus_ord"), ["corpus", "pre"]
    )
    # A guid defined by several documents takes the last one's wording.
    canonical = terms.groupBy(F.col("node_id").alias("guid")).agg(F.max_by("term", F.struct("corpus_ord", "pre")).alias("canonical"))
    numbers = (
        nodes.select("corpus", "pre", attr("num").alias("num"))
        .join(child_text(nodes, "sptc", "sptc"), ["corpus", "pre"], "left")
        .select(
            F.col("corpus").alias("t_corpus"), F.col("pre").alias("t_pre"),
            blank_to_null(strip(F.coalesce(blank_to_null("sptc"), F.col("num")))).alias("own_number"),
        )
        .where(F.col("own_number").isNotNull())
    )
    sources = child_attr(nodes, "img", "src", "filename").join(images.select("corpus", "filename"), ["corpus", "filename"], "left_semi")
    sources = sources.select(F.col("corpus").alias("t_corpus"), F.col("pre").alias("t_pre"), "filename")
    kind = (
        F.when(F.col("type") == "abcb-glossentry", "term")
        .when(F.col("type") == "image-reference", "image")
        .when(F.col("declared").isNotNull(), "external")
        .when(F.col("type").isin(*CLAUSE_LINK_TYPES), "internal")
        .otherwise("plain")
    )
    joined = (
        resolved.withColumn("kind", kind)
        .join(canonical, "guid", "left")
        .join(numbers, ["t_corpus", "t_pre"], "left")
        .join(sources, ["t_corpus", "t_pre"], "left")
    )
    known = F.col("t_pre").isNotNull()
    return joined.withColumn("t_guid", F.when(known, F.col("guid"))).withColumn(
        "term", F.coalesce(F.when(known, F.col("canonical")), F.col("raw_text"))
    ).drop("canonical")


def representative_chunks(nodes: DataFrame) -> DataFrame:
    """(t_corpus, t_guid, chunk_id): the chunk that stands for an element. A clause
    is stood for by its first subclause, else subclause variation, else callout."""
    direct = guid_index(nodes).where(F.col("tag").isin(*DIRECT_TAGS)).select(
        "corpus", F.col("node_id").alias("guid"), guid_to_id("node_id").alias("chunk_id"), F.lit(0).alias("w"), F.lit(0).cast("long").alias("at")
    )
    parts = inside(nodes.where(F.col("tag").isin("subclause", "subclause-variation", "callout")), CLAUSE_LIKE, itself=False)
    rank = F.when(F.col("tag") == "subclause", 0).when(F.col("tag") == "subclause-variation", 1).otherwise(2)
    first = parts.groupBy("corpus", F.col("within").alias("pre")).agg(F.min_by("node_id", F.struct(rank, "pre")).alias("first_id"))
    clauses = guid_index(nodes).where(F.col("tag").isin(*CLAUSE_LIKE)).join(first, ["corpus", "pre"])
    roots = clauses.where(blank_to_null("first_id").isNotNull()).select(
        "corpus", F.col("node_id").alias("guid"), guid_to_id("first_id").alias("chunk_id"), F.lit(1).alias("w"), F.col("pre").alias("at")
    )
    best = union_all([direct, roots]).groupBy("corpus", "guid").agg(F.min_by("chunk_id", F.struct("w", "at")).alias("chunk_id"))
    return best.select(F.col("corpus").alias("t_corpus"), F.col("guid").alias("t_guid"), "chunk_id")


def number_index(nodes: DataFrame, corpus: str) -> DataFrame:
    """(label, number, t_guid) of one corpus, for numbers used once per label."""
    rows = nodes.where((F.col("corpus") == corpus) & F.col("tag").isin(*[t for t, _ in CITED_TAGS])).join(
        child_text(nodes, "sptc", "sptc"), ["corpus", "pre"], "left"
    )
    label = F.coalesce(*[F.when(F.col("tag") == t, F.lit(name)) for t, name in CITED_TAGS])
    number = blank_to_null(F.when(F.col("tag") == "clause", F.col("sptc")).otherwise(attr("num")))
    return unique_numbers(rows.select(label.alias("label"), strip(number).alias("number"), F.col("node_id").alias("t_guid")).where(F.col("number").isNotNull()))


def unique_numbers(rows: DataFrame) -> DataFrame:
    """(label, number, t_guid) of the numbers that name one element only."""
    counted = rows.groupBy("label", "number").agg(F.count(F.lit(1)).alias("n"), F.min("t_guid").alias("t_guid"))
    return counted.where(F.col("n") == 1).drop("n")


def cited_standards(chunks: DataFrame, schedule: DataFrame, key: str = "id") -> DataFrame:
    """(key, ord, mention, standard, title): every mention with its schedule entry, if any."""
    rows = chunks.select(key, F.posexplode(standard_mentions("text")).alias("ord", "mention"))
    entries = schedule.select(F.col("key").alias("_key"), "standard", "title")
    return rows.withColumn("_key", normalise_standard("mention")).join(entries, "_key", "left").drop("_key")


def cited_in_prose(chunks: DataFrame, numbers: DataFrame, key: str = "id") -> DataFrame:
    """(key, ord, display, raw_text, t_guid): unlinked citations, with their
    target where the number is unique. Sections never resolve."""
    rows = chunks.select(key, F.posexplode(prose_citations("text")).alias("ord", "c")).select(key, "ord", "c.*")
    return rows.join(numbers, ["label", "number"], "left")


def build_references(
    nodes: DataFrame,
    chunks: DataFrame,
    images: DataFrame,
    cited_corpus: str,
    cited_kind: str = "housing",
    strict: bool = False,
) -> DataFrame:
    """Reference edges of all chunks, resolved to chunk ids.

    (corpus, pre, list, ord, kind, clause_id, raw_text, chunk_id, standard,
    title, image_id, filename, described) where `list` names the chunk column an
    edge belongs to. A chunk takes the links of its whole subtree; `strict` leaves
    those of nested variations to the variations.
    """
    from corpuskit.operators.rendering import standards_schedule

    anchors = clause_anchors(nodes).select("corpus", "pre")
    # Read by two and by five others: stored, the joins that make them run once.
    placed = stored(classified_links(nodes, images))
    above = placed.select("corpus", F.col("pre").alias("link"), F.posexplode("pre_path").alias("at", "pre"))
    owners = above.join(anchors, ["corpus", "pre"])
    if strict:
        nearest = owners.groupBy("corpus", "link").agg(F.max("pre").alias("pre"))
        owners = nearest
    found = stored(owners.select("corpus", "pre", "link").join(
        placed.withColumnRenamed("pre", "link").drop("pre_path", "tag_path"), ["corpus", "link"]
    ))
    none = F.lit(None).cast("string")

    def edges(df: DataFrame, column: str, order: Column, **values: Column) -> DataFrame:
        blank = {
            "kind": none, "clause_id": none, "raw_text": none, "chunk_id": none, "standard": none, "title": none,
            "image_id": none, "filename": none, "described": F.lit(None).cast("boolean"),
            "matched": F.lit(None).cast("boolean"), "t_corpus": none, "t_guid": none,
        }
        return df.select(
            "corpus", "pre", F.lit(column).alias("list"), order.alias("ord"), *[v.alias(k) for k, v in {**blank, **values}.items()]
        )

    def at(step: int, first: Column, second: Column = F.lit(0)) -> Column:
        return F.struct(F.lit(step).alias("a"), first.cast("long").alias("b"), second.cast("long").alias("c"))

    link = at(0, F.col("link"))
    target = {"t_corpus": F.col("t_corpus"), "t_guid": F.col("t_guid")}
    raw = F.col("raw_text")
    cross = edges(found, "cross_refs", link, raw_text=raw)
    terms = found.where(F.col("kind") == "term").groupBy("corpus", "pre", "term").agg(F.min("link").alias("link"))
    terms = edges(terms, "defined_terms", link, raw_text=F.col("term"))
    pictures = found.where((F.col("kind") == "image") & F.col("filename").isNotNull())
    pictures = pictures.groupBy("corpus", "pre", "t_guid").agg(
        F.min("link").alias("link"), F.min_by(F.struct("filename", "raw_text"), "link").alias("f")
    )
    pictures = edges(pictures, "image_refs", link, image_id=guid_to_id("t_guid"), filename=F.col("f.filename"), raw_text=F.col("f.raw_text"))
    internal = edges(found.where(F.col("kind") == "internal"), "internal_refs", link, clause_id=raw, **target)
    external = edges(
        found.where(F.col("kind") == "external"), "external_refs", link, kind=F.col("declared"),
        clause_id=F.coalesce(F.when(F.col("t_pre").isNotNull(), F.col("own_number")), raw), raw_text=raw, **target,
    )
    keyed = chunks.withColumn("key", F.struct("corpus", "pre"))
    standards = cited_standards(keyed, standards_schedule(nodes), "key").select("key.*", "*")
    standards = edges(
        standards, "external_refs", at(1, F.col("ord")), kind=F.lit("standard"),
        standard=F.coalesce("standard", "mention"), title=F.col("title"), matched=F.col("standard").isNotNull(),
    )
    prose = cited_in_prose(keyed, number_index(nodes, cited_corpus), "key").select("key.*", "*")
    prose = edges(
        prose, "external_refs", at(2, F.col("ord")), kind=F.lit(cited_kind), clause_id=F.col("display"), raw_text=raw,
        t_corpus=F.lit(cited_corpus), t_guid=F.col("t_guid"),
    )
    own = own_figures(nodes, images)
    every = union_all([cross, terms, pictures, internal, external, standards, prose, edges(own, "image_refs", at(0, F.col("pre")),
        image_id=F.col("image_id"), filename=F.col("filename"), raw_text=F.col("caption"), described=F.lit(False))])
    stand_ins = representative_chunks(nodes).select("t_corpus", F.col("t_guid").alias("_guid"), F.col("chunk_id").alias("_chunk_id"))
    # Most edges have no target: under one key, a single task would sort them all.
    keyed = every.drop("chunk_id").withColumn("_guid", F.coalesce("t_guid", F.concat(F.lit("\0"), F.col("pre").cast("string"))))
    return keyed.join(stand_ins, ["t_corpus", "_guid"], "left").drop("_guid").withColumnRenamed("_chunk_id", "chunk_id")


def own_figures(nodes: DataFrame, images: DataFrame) -> DataFrame:
    """(corpus, pre, image_id, filename, caption) of figures whose file is there."""
    rows = (
        nodes.where(F.col("tag") == "image-reference")
        .join(child_attr(nodes, "img", "src", "filename"), ["corpus", "pre"])
        .join(child_text(nodes, "title", "title"), ["corpus", "pre"], "left")
        .join(images.select("corpus", "filename"), ["corpus", "filename"], "left_semi")
    )
    return rows.select("corpus", "pre", guid_to_id(F.coalesce("node_id", F.lit(""))).alias("image_id"), "filename", figure_heading().alias("caption"))


def nest_references(chunks: DataFrame, edges: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """Chunks with their five reference lists, each in order.

    described: (corpus, pre) of the figure chunks that have a description.
    """
    if described is not None:
        marks = described.select("corpus", "pre", F.lit(True).alias("_described"))
        edges = edges.join(marks, ["corpus", "pre"], "left").withColumn(
            "described", F.when(F.col("described").isNotNull(), F.coalesce("_described", "described"))
        )

    def gather(name: str, value: Column) -> Column:
        kept = F.sort_array(F.collect_list(F.when(F.col("list") == name, F.struct(F.col("ord"), value.alias("v")))))
        return kept["v"].alias(name)

    # Lists of elements that are not among the chunks may be long, and are not asked for.
    lists = edges.join(chunks.select("corpus", "pre"), ["corpus", "pre"], "left_semi").groupBy("corpus", "pre").agg(
        gather("defined_terms", F.col("raw_text")),
        gather("cross_refs", F.col("raw_text")),
        gather("internal_refs", F.struct("clause_id", "chunk_id")),
        gather("image_refs", F.struct("image_id", "filename", F.col("raw_text").alias("caption"), "described")),
        gather("external_refs", F.struct("kind", "clause_id", "raw_text", "chunk_id", "standard", "title")),
    )
    joined = chunks.join(lists, ["corpus", "pre"], "left")
    for name in ("defined_terms", "cross_refs", "internal_refs", "image_refs", "external_refs"):
        joined = joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return joined
