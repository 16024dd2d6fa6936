"""A stored inverted index: all-terms search that reads only the asked terms.

The corpus is laid out in blocks of documents end to end. For each term and block
there is one posting: the places of the term in the block as differences in the
fewest bytes, in how many documents it stands, and its largest count in one of
them. Postings lie in folders by term hash, sorted by term, so a search reads the
folders of its terms only, and of those first the small columns.

A block can answer a query only if it has a posting of each term; its best cover
score is at most the sum of the terms' largest counts, less one for each term but
the first. With `k`, the blocks of highest bound are scored first, and others only
where their bound reaches the k-th score found so far. Scores are those of
`operators.lexical`; inside a block documents are met from the rarest term on.

A hot term has one posting a block and moves at most once a search, whatever the
number of queries that ask for it; a task holds one block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from corpuskit.functions.analyzer import Analyzer, simple
from corpuskit.operators.dense import DECIMALS, POOL
from corpuskit.operators.dictionary import sharing_stems
from corpuskit.operators.filters import searchable
from corpuskit.operators.lexical import COVER_LENGTH, cover_density, prepared_queries, with_tokens
from corpuskit.operators.ranking import merge_top_k, union_all
from corpuskit.operators.shortlist import ShortLists, comparable_ids, open_rows
from corpuskit.session import shared_folder
from corpuskit.sizing import StoredQueries, block_reader, store_queries

BLOCK_TOKENS = 1 << 20
BLOCK_DOCUMENTS = 1 << 13
BUCKETS = 32
HOME = -1  # the folder of the blocks' documents
FIRST_BLOCKS = 16  # blocks of highest bound that a search scores first
EITHER = "|"  # between words that stand for one term of a query
SLOT_QUERIES = 1 << 14  # queries that meet a block at once


@dataclass(frozen=True)
class Index:
    """A stored index: where, and how its texts were analysed."""

    path: str
    buckets: int
    blocks: int
    analyzer: Analyzer
    schema: T.StructType

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _row_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("documents", T.LongType()),
            T.StructField("largest", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("places", T.BinaryType()),
            T.StructField("ids", T.ArrayType(id_type)), T.StructField("jurisdictions", T.ArrayType(T.ArrayType(T.StringType()))),
            T.StructField("lengths", T.ArrayType(T.LongType())),
        ]
    )


def _blocks(schema: T.StructType, block_tokens: int, block_documents: int):
    """Batch function from (id, jurisdictions, tokens) rows to rows of the index."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)

    def rows(count: int, **columns):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(count, f.type) for f in fields], schema=fields)

    def block(part) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        name, documents = uuid.uuid4().int >> 65, part.num_rows
        column = part.column("tokens")
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)

        def one_list(values):
            return pa.ListArray.from_arrays(pa.array([0, documents], pa.int32()), values)

        yield rows(
            1, block=pa.array([name]), ids=one_list(part.column("id")), jurisdictions=one_list(part.column("jurisdictions")), lengths=one_list(pa.array(lengths))
        )
        coded = column.flatten().dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(code >= 0)
        if not len(places):
            return
        places = places[np.argsort(code[places], kind="stable")]
        held = code[places]
        owner = np.repeat(np.arange(documents), lengths)[places]
        begin = np.flatnonzero(np.diff(held, prepend=-1))
        step = np.diff(places, prepend=0)
        step[begin] = places[begin]
        # Runs of one term in one document.
        run = np.ones(len(places), bool)
        run[1:] = (held[1:] != held[:-1]) | (owner[1:] != owner[:-1])
        runs = np.flatnonzero(run)
        first_run = np.searchsorted(runs, begin)
        largest = np.maximum.reduceat(np.diff(np.append(runs, len(places))), first_run)
        in_documents = np.diff(np.append(first_run, len(runs)))
        size = np.diff(np.append(begin, len(places)))
        widest = np.maximum.reduceat(step, begin)
        width = np.where(widest < 1 << 8, 1, np.where(widest < 1 << 16, 2, 4))
        for w in (1, 2, 4):
            chosen = np.flatnonzero(width == w)
            if len(chosen):
                body = step[np.repeat(width == w, size)].astype(f"<u{w}").tobytes()
                ends = np.concatenate([[0], np.cumsum(size[chosen] * w)])
                yield rows(
                    len(chosen), block=pa.array(np.full(len(chosen), name)), term=coded.dictionary.take(pa.array(held[begin[chosen]])),
                    documents=pa.array(in_documents[chosen]), largest=pa.array(largest[chosen]), width=pa.array(np.full(len(chosen), w)),
                    places=pa.Array.from_buffers(pa.large_binary(), len(chosen), [None, pa.py_buffer(ends), pa.py_buffer(body)]),
                )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held, tokens, documents = [], 0, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = int(ends[begin - 1]) if begin else 0
                stop = int(np.searchsorted(ends, before + block_tokens - tokens, side="right"))
                stop = min(max(stop, begin + (not held)), begin + block_documents - documents)
                held.append(batch.slice(begin, stop - begin))
                tokens, documents = tokens + (int(ends[stop - 1]) if stop else 0) - before, documents + stop - begin
                begin = stop
                if begin < batch.num_rows or tokens >= block_tokens or documents >= block_documents:
                    yield from block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, tokens, documents = [], 0, 0
        if documents:
            yield from block(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def build(
    chunks: DataFrame,
    analyzer: Analyzer = simple,
    path: str | None = None,
    buckets: int = BUCKETS,
    block_tokens: int = BLOCK_TOKENS,
    block_documents: int = BLOCK_DOCUMENTS,
) -> Index:
    """Writes the index of all searchable chunks (id, node_type, jurisdictions, and
    heading and text or tokens) to `path`, or a new folder in the shared one."""
    spark = chunks.sparkSession
    path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    corpus = with_tokens(searchable(chunks), analyzer).select("id", "jurisdictions", "tokens")
    schema = _row_schema(corpus.schema["id"].dataType)
    rows = corpus.mapInArrow(_blocks(schema, block_tokens, block_documents), schema)
    placed = rows.withColumn("bucket", F.when(F.col("term").isNull(), F.lit(HOME)).otherwise(bucket_of(F.col("term"), buckets)))
    # Rebalancing keeps folders of even files, and splits a bucket that is too large.
    placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    written = spark.read.schema(placed.schema).parquet(path)
    return Index(path, buckets, written.where(F.col("bucket") == HOME).count(), analyzer, placed.schema)


def _block_scorer(key_type, id_type, k: int | None, cover_length: int, decimals: int):
    """Function scoring queries over the postings of a block."""

    def score(rows, queries: Iterator):
        import pyarrow as pa

        out = []
        place_of = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
        if None in place_of:
            home = rows.slice(place_of[None], 1)
            lengths = home.column("lengths").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            ids = comparable_ids(home.column("ids").combine_chunks().flatten())
            jurisdictions = home.column("jurisdictions").combine_chunks().flatten()
            width = rows.column("width").to_pylist()
            body, decoded = rows.column("places"), {}

            def places(i: int):
                if i not in decoded:
                    at = np.cumsum(np.frombuffer(body[i].as_py(), f"<u{width[i]}").astype(np.int64))
                    owner = np.searchsorted(ends, at, side="right")
                    present = np.zeros(len(ids), bool)
                    present[owner] = True
                    decoded[i] = at, owner, present
                return decoded[i]

            def together(term: str):
                """The places of a term, or of several words that stand for one."""
                if term not in merged:
                    parts = [places(place_of[w]) for w in term.split(EITHER) if w in place_of]
                    if len(parts) > 1:
                        at, owner = (np.concatenate(x) for x in list(zip(*parts))[:2])
                        order = np.argsort(at, kind="stable")
                        parts = [(at[order], owner[order], np.logical_or.reduce([p[2] for p in parts]))]
                    merged[term] = parts[0] if parts else None
                return merged[term]

            merged = {}
            for asked in queries:
                wanted, terms_of = asked.column("jurisdiction").to_pylist(), asked.column("terms").to_pylist()
                open_to = open_rows(wanted, jurisdictions)
                best = ShortLists(asked.column("query_id").to_pylist(), k)
                for j, terms in enumerate(terms_of):
                    found = [together(t) for t in terms] if terms and all(EITHER in t or t in place_of for t in terms) else []
                    if not found or any(f is None for f in found):
                        continue
                    rarest_first = sorted(found, key=lambda f: f[0].size)
                    hit = np.ones(len(ids), bool) if wanted[j] is None else open_to[wanted[j]].copy()
                    for _, _, present in rarest_first:
                        hit &= present
                        if not hit.any():
                            break
                    else:
                        kept = [at[hit[owner]] for at, owner, _ in rarest_first]
                        sums = cover_density(kept, ends, begins, cover_length)
                        best.add(j, -np.round(sums[hit], decimals), ids[hit])
                q, names, costs = best.rows()
                out.append(pa.table([pa.array(q, key_type), pa.array(names, id_type), pa.array([-c for c in costs], pa.float64())], names=["query_id", "id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], key_type), pa.array([], id_type), pa.array([], pa.float64())], names=["query_id", "id", "score"])

    return score


def _scored(postings: DataFrame, homes: DataFrame, terms: DataFrame, wanted: DataFrame | None, stored: StoredQueries, slots: int, k, cover_length, decimals) -> DataFrame:
    """Scores of (query_id, jurisdiction, terms, block) rows; without such rows, of
    all stored queries in all blocks."""
    from pyspark.sql.pandas.types import to_arrow_type

    columns = ["block", "term", "documents", "width", "places", "ids", "jurisdictions", "lengths"]
    rows = union_all([homes.select(*columns), postings.join(terms, "term", "left_semi").select(*columns)])
    id_type = homes.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query_id", stored.id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    scorer = _block_scorer(to_arrow_type(stored.id_type), to_arrow_type(id_type), k, cover_length, decimals)
    if wanted is None:
        queries = block_reader(stored, ["query_id", "jurisdiction", "terms"])
        return rows.groupBy("block").applyInArrow(lambda own: scorer(own, queries()), schema)
    rows = rows.join(wanted.select("block").distinct(), "block", "left_semi")
    slot = F.pmod(F.xxhash64("query_id"), F.lit(slots)).cast("int")
    dealt = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))) if slots > 1 else rows.withColumn("slot", F.lit(0))
    asked = wanted.select(F.col("block").alias("in_block"), slot.alias("in_slot"), "query_id", "jurisdiction", "terms")
    groups = dealt.groupBy("block", "slot").cogroup(asked.groupBy("in_block", "in_slot"))
    return groups.applyInArrow(lambda own, queries: scorer(own, queries.to_batches()), schema)


def words(index: Index, spark: SparkSession) -> DataFrame:
    """(term): the distinct words of the index, read from that column alone."""
    return index.read(spark).where(F.col("bucket") != HOME).select("term").distinct()


def english_queries(index: Index, queries: DataFrame, dictionary: DataFrame) -> StoredQueries:
    """Stored queries that ask an index of plain words for all words with the stems of
    theirs: the same matches as an index of stems gives, from one index for both."""
    return store_queries(sharing_stems(prepared_queries(queries, index.analyzer), dictionary))


def matches(
    index: Index,
    queries: DataFrame | StoredQueries,
    k: int | None = None,
    cover_length: int = COVER_LENGTH,
    decimals: int = DECIMALS,
    spark: SparkSession | None = None,
) -> DataFrame:
    """(query_id, id, score) for every chunk holding all terms of a query and open to
    its jurisdiction; with `k`, short lists that hold each query's k best."""
    spark = spark or (queries.sparkSession if isinstance(queries, DataFrame) else SparkSession.active())
    stored = queries if isinstance(queries, StoredQueries) else store_queries(prepared_queries(queries, index.analyzer))
    own = spark.read.parquet(stored.path).select("query_id", "jurisdiction", "terms").where(F.size("terms") > 0)
    asked = own.select("query_id", F.posexplode("terms").alias("place", "term"), F.size("terms").alias("n"))
    asked = asked.select("query_id", "place", "n", F.explode(F.split("term", f"[{EITHER}]")).alias("term"))
    # At most one number a folder.
    folders = [r[0] for r in asked.select(bucket_of(F.col("term"), index.buckets)).distinct().collect()]
    table = index.read(spark)
    homes, postings = table.where(F.col("bucket") == HOME), table.where(F.col("bucket").isin(folders))
    terms = asked.select("term").distinct()
    if k is None or index.blocks <= FIRST_BLOCKS:
        return _scored(postings, homes, terms, None, stored, 1, k, cover_length, decimals)
    slots = -(-max(own.count(), 1) // SLOT_QUERIES)
    candidates = (
        postings.select("term", "block", "largest").join(asked, "term").groupBy("query_id", "block")
        .agg(F.count_distinct("place").alias("held"), F.first("n").alias("n"), F.sum("largest").alias("counts"))
        .where("held = n").select("query_id", "block", (F.col("counts") - F.col("n") + 1).alias("bound"))
    )

    def scored(chosen: DataFrame) -> DataFrame:
        return _scored(postings, homes, terms, chosen.join(own, "query_id"), stored, slots, k, cover_length, decimals)

    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    placed = candidates.withColumn("turn", F.row_number().over(order))
    folder = f"{shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
    placed.write.parquet(f"{folder}/blocks")
    placed = spark.read.parquet(f"{folder}/blocks")
    scored(placed.where(F.col("turn") <= FIRST_BLOCKS)).write.parquet(f"{folder}/first")
    first = spark.read.parquet(f"{folder}/first")
    # The k-th score so far; a block below it has none of the k best.
    reached = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    floor = first.withColumn("r", F.row_number().over(reached)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    rest = placed.where(F.col("turn") > FIRST_BLOCKS).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    return union_all([first, scored(rest.select("query_id", "block"))])


def top_k(index: Index, queries: DataFrame | StoredQueries, k: int = POOL, cover_length: int = COVER_LENGTH, decimals: int = DECIMALS) -> DataFrame:
    """(query_id, id, score, rank): the k best all-terms matches per query, equal
    scores ranked by id. The same as `lexical_top_k` over the indexed chunks."""
    found = matches(index, queries, k, cover_length, decimals)
    return merge_top_k(found, ["query_id"], "id", [F.col("score").desc(), F.col("id")], k)
