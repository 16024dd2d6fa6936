"""Structured documents as a table of elements.

Every file is read whole by one task and streamed through an event parser, so a
task holds one file's bytes and one path of open elements; a document that comes in
pieces is never held whole. Work is spread over documents. Mixed content keeps its
order through `text` and `tail`.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate, chain, groupby, islice

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuskit.schemas import NODES

BATCH = 5000
STEP = 1 << 20
PRE, LAST, TEXT, TAIL, TAG_PATH, PRE_PATH, NTH_PATH = (NODES.fieldNames().index(n) for n in ("pre", "last", "text", "tail", "tag_path", "pre_path", "nth_path"))


@dataclass(frozen=True)
class Corpus:
    """One document: its key, its label, and where it lies."""

    name: str
    doc_label: str
    path: str


def corpora_table(spark: SparkSession, corpora: Iterable[Corpus]) -> DataFrame:
    """(corpus, doc_label, path, corpus_ord), in the given order."""
    rows = [(c.name, c.doc_label, c.path, i) for i, c in enumerate(corpora)]
    return spark.createDataFrame(rows, "corpus string, doc_label string, path string, corpus_ord int")


def _elements(corpus: str, parts: Iterable[bytes]):
    """Yields one record per element, its values in the order of NODES. A record is
    complete once its tail is known, so elements come out in closing order; `pre`
    gives document order. parts: the document's bytes, cut anywhere."""
    from xml.parsers import expat

    parser = expat.ParserCreate()
    parser.buffer_text = True
    open_nodes: list[list] = []
    children: list[dict[str, int]] = []  # per open element: its children so far, by tag
    closed: list[list] = []
    waiting: list[list | None] = [None]  # per depth: the last closed child, tail still open
    count = 0
    publishing = None

    def opened(tag, attrs):
        nonlocal count, publishing
        depth = len(open_nodes)
        before = waiting[depth]
        if before is not None:
            closed.append(before)
            waiting[depth] = None
        if depth:
            parent, seen = open_nodes[-1], children[-1]
            nth = seen.get(tag, 0)
            node = [
                corpus, publishing, attrs.get("id"), count, count, parent[PRE], sum(seen.values()), nth, depth, tag, attrs, "", "",
                [*parent[TAG_PATH], tag], [*parent[PRE_PATH], count], [*parent[NTH_PATH], nth],
            ]
            seen[tag] = nth + 1
        else:
            publishing = attrs.get("publishing-id")
            node = [corpus, publishing, attrs.get("id"), count, count, None, 0, 0, 0, tag, attrs, "", "", [tag], [count], [0]]
        count += 1
        open_nodes.append(node)
        children.append({})
        waiting.append(None)

    def ended(_tag):
        node = open_nodes.pop()
        children.pop()
        last = waiting.pop()
        if last is not None:
            closed.append(last)
        node[LAST] = count - 1
        waiting[-1] = node

    def characters(data):
        before = waiting[-1]
        if before is not None:
            before[TAIL] += data
        elif open_nodes:
            open_nodes[-1][TEXT] += data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = opened, ended, characters
    for content in parts:
        for start in range(0, len(content), STEP):
            parser.Parse(content[start : start + STEP], False)
            yield from closed
            closed.clear()
    parser.Parse(b"", True)
    yield from closed
    yield waiting[0]


def _batches(nodes: Iterable[list], schema: T.StructType):
    """Arrow batches of at most BATCH of the records."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)

    def column(values, kind):
        """Nested values go in flat, with offsets: Arrow takes Python's lists one by one."""
        if not pa.types.is_nested(kind):
            return pa.array(values, kind)
        ends = pa.array([0, *accumulate(map(len, values))], pa.int32())
        if pa.types.is_map(kind):
            keys = pa.array(list(chain.from_iterable(values)), kind.key_type)
            return pa.MapArray.from_arrays(ends, keys, pa.array([v for d in values for v in d.values()], kind.item_type)).cast(kind)
        return pa.ListArray.from_arrays(ends, pa.array(list(chain.from_iterable(values)), kind.value_type)).cast(kind)

    rows = iter(nodes)
    while held := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([column(values, f.type) for values, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)


def _rows(batches, *names: str):
    """The batches' rows, one at a time."""
    for part in batches:
        columns = [part.column(name) for name in names]
        for row in range(part.num_rows):
            yield tuple(c[row].as_py() for c in columns)


def _parser(schema: T.StructType):
    """Batch function from (corpus, content, doc_label, corpus_ord) rows to elements."""

    def nodes(batches):
        for corpus, content, label, place in _rows(batches, "corpus", "content", "doc_label", "corpus_ord"):
            for node in _elements(corpus, [content]):
                node += (label, place)
                yield node

    return lambda batches: _batches(nodes(batches), schema)


def _piece_parser(schema: T.StructType):
    """Batch function from sorted rows of labels and pieces to elements: see `parse_pieces`."""

    def nodes(batches):
        rows = _rows(batches, "corpus", "document", "content", "doc_label", "corpus_ord")
        for corpus, of_corpus in groupby(rows, lambda r: r[0]):
            labels = []
            for (piece, _), found in groupby(of_corpus, lambda r: (r[2] is not None, r[1])):
                if not piece:
                    labels = [r[3:] for r in found]
                elif labels:
                    for node in _elements(corpus, _joined(r[2] for r in found)):
                        for label in labels:
                            yield [*node, *label]

    return lambda batches: _batches(nodes(batches), schema)


def _joined(pieces: Iterable[bytes]):
    """The pieces, as many at once as make about a step."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= STEP:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


def local_path_of(path: str):
    """`local_path` of a path known now."""
    return _bare(F.lit(path))


def _bare(path):
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    return F.regexp_replace(F.regexp_replace(bare, "/+", "/"), "(?<=.)/$", "")


def local_path(column: str, encoded: bool = False):
    """The path of a URI or plain path without scheme, authority, doubled or
    trailing slashes, so that spellings of one file compare equal. `encoded`:
    the column is a URI as `_metadata.file_path` spells it."""
    path = F.col(column)
    if encoded:
        path = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return _bare(path)


def _width(spark: SparkSession) -> int:
    """One document is one unit of work: they are dealt out so that tasks stay even."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _element_schema(corpora: DataFrame) -> T.StructType:
    return T.StructType([*NODES.fields, corpora.schema["doc_label"], corpora.schema["corpus_ord"]])


def parse_documents(documents: DataFrame, corpora: DataFrame) -> DataFrame:
    """Element table of (corpus, content) rows, with the label and order of their
    corpus. content: the XML of one whole document."""
    dealt = documents.select("corpus", F.col("content").cast("binary").alias("content")).repartition(_width(documents.sparkSession), "corpus")
    # The label goes with the document: joined afterwards it would move every element.
    labelled = dealt.join(corpora.select("corpus", "doc_label", "corpus_ord"), "corpus")
    schema = _element_schema(corpora)
    return labelled.mapInArrow(_parser(schema), schema)


def parse_pieces(pieces: DataFrame, corpora: DataFrame) -> DataFrame:
    """`parse_documents` of documents too long for one cell: (corpus, document, place,
    content) rows, whose contents by `place`, then by themselves, make up the XML of a
    document of the corpus. Pieces without content or corpus are left out.

    A task sorts the pieces of its documents, on disk where they are many, and feeds
    them to the parser one after another.
    """
    label = corpora.select("corpus", "doc_label", "corpus_ord")
    none = {c: F.lit(None).cast(pieces.schema[c].dataType if c != "content" else "binary") for c in ("document", "place", "content")}
    texts = pieces.where(F.col("content").isNotNull()).select(
        "corpus", "document", "place", F.col("content").cast("binary").alias("content"),
        *[F.lit(None).cast(label.schema[c].dataType).alias(c) for c in ("doc_label", "corpus_ord")],
    )
    # A corpus' labels go before its pieces: a join could cut a long document apart.
    rows = texts.unionByName(label.withColumns(none)).where(F.col("corpus").isNotNull())
    dealt = rows.repartition(_width(pieces.sparkSession), "corpus").sortWithinPartitions("corpus", F.col("content").isNotNull(), "document", "place", "content")
    schema = _element_schema(corpora)
    return dealt.mapInArrow(_piece_parser(schema), schema)


def scan_documents(spark: SparkSession, corpora: DataFrame, paths: list[str] | str) -> DataFrame:
    """`parse_documents` over the files named in `corpora`.

    `paths` are the folders or files to read; a file not named in `corpora` is left
    out, and a corpus whose file is not among them fails the read.
    """
    files = spark.read.format("binaryFile").load(paths).select(local_path("path").alias("path"), "content")
    named = corpora.select("corpus", local_path("path").alias("path")).join(files, "path", "left")
    missing = F.raise_error(F.concat(F.lit("no file was read for corpus "), F.col("corpus"))).cast("binary")
    return parse_documents(named.withColumn("content", F.coalesce("content", missing)), corpora)
