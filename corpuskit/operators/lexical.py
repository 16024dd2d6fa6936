"""Full-text search: all-terms match ranked by cover density.

One pass over the corpus, like the dense side: the text is analysed natively,
every task scores its Arrow batches for each block of stored queries and keeps its
own top-k per query, and only those short lists move.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from corpuskit.functions.analyzer import Analyzer, query_terms, search_document, simple
from corpuskit.operators.dense import DECIMALS, POOL
from corpuskit.operators.filters import searchable
from corpuskit.operators.ranking import merge_top_k
from corpuskit.operators.shortlist import ShortLists, comparable_ids, open_rows
from corpuskit.sizing import StoredQueries, block_reader, by_block, store_queries

COVER_LENGTH = 16  # covers up to this long score 1, longer ones score this / length


def with_tokens(chunks: DataFrame, analyzer: Analyzer = simple) -> DataFrame:
    """Adds `tokens`, the analysed heading and text. Store it with the corpus;
    the search then never re-reads the text."""
    if "tokens" in chunks.columns:
        return chunks
    tokens = analyzer(search_document("heading", "text"))
    # A one-row generator keeps the optimizer from copying the analysis into
    # every expression that mentions it.
    return chunks.select("*", F.explode(F.array(tokens)).alias("tokens"))


def postings(chunks: DataFrame, analyzer: Analyzer = simple) -> DataFrame:
    """(id, term, pos), positions from 1; stop words leave gaps."""
    tokens = with_tokens(chunks, analyzer)
    return (
        tokens.select("id", F.posexplode("tokens").alias("p", "term"))
        .where(F.col("term").isNotNull())
        .select("id", "term", (F.col("p") + 1).alias("pos"))
    )


def term_statistics(chunks: DataFrame, analyzer: Analyzer = simple) -> DataFrame:
    """(term, documents, occurrences), reduced on the map side in one grouping."""
    tokens = with_tokens(chunks, analyzer).select(F.filter("tokens", lambda t: t.isNotNull()).alias("tokens"))

    def marked(terms, in_document: int):
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(in_document).alias("d")))

    both = F.concat(marked(F.array_distinct("tokens"), 1), marked(F.col("tokens"), 0))
    rows = tokens.select(F.inline(both))
    return rows.groupBy("term").agg(
        F.count_if(F.col("d") == 1).alias("documents"), F.count_if(F.col("d") == 0).alias("occurrences")
    )


def prepared_queries(queries: DataFrame, analyzer: Analyzer = simple) -> DataFrame:
    """(query_id, jurisdiction, terms). Queries without terms match nothing and go."""
    return queries.select(
        "query_id", "jurisdiction", query_terms(F.col("query_text"), analyzer).alias("terms")
    ).where(F.size("terms") > 0)


def cover_density(places: list[np.ndarray], ends: np.ndarray, begins: np.ndarray, cover_length: int) -> np.ndarray:
    """Scores of documents that lie end to end, from the places of every term in
    those that hold all terms.

    Every term's latest place is looked up at every mark, the smallest of them opens
    the shortest span ending there, and a span counts at the first mark reaching it.
    """
    here = np.sort(np.concatenate(places))
    opens = np.full(here.size, np.iinfo(np.int64).max)
    for p in places:
        seen = np.searchsorted(p, here, side="right")
        opens = np.minimum(opens, np.where(seen > 0, p[seen - 1], -1))
    owner = np.searchsorted(ends, here, side="right")
    whole = opens >= begins[owner]
    here, opens, owner = here[whole], opens[whole], owner[whole]
    first = np.ones(here.size, dtype=bool)
    first[1:] = opens[1:] != opens[:-1]
    gain = np.minimum(1.0, cover_length / (here[first] - opens[first] + 1))
    return np.bincount(owner[first], weights=gain, minlength=len(ends))


def _cover_kernel(stored: StoredQueries, key_type, id_type, k: int | None, cover_length: int, decimals: int):
    """Batch function scoring (id, jurisdictions, tokens) rows for a query block.

    All documents of a step are laid end to end, so one query is scored with a
    few array operations over the positions of its own terms.
    """
    blocks = block_reader(stored, ["query_id", "jurisdiction", "terms"])

    def score(block, batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        block = block.filter(pc.greater(pc.fill_null(pc.list_value_length(block.column("terms")), 0), 0))
        if not block.num_rows:
            return
        keys, asked = block.column("query_id").to_pylist(), block.column("jurisdiction").to_pylist()
        terms_of_query = block.column("terms").to_pylist()
        vocabulary = sorted({t for terms in terms_of_query for t in terms})
        code_of = {t: i for i, t in enumerate(vocabulary)}
        codes_of_query = [[code_of[t] for t in terms] for terms in terms_of_query]
        known = pa.array(vocabulary, type=pa.string())

        def scan(rows, best):
            column = rows.column("tokens")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            begins = ends - lengths
            code = pc.fill_null(pc.index_in(column.flatten(), known), -1).to_numpy(zero_copy_only=False)
            marks = np.flatnonzero(code >= 0)
            marks = marks[np.argsort(code[marks], kind="stable")]
            cuts = np.searchsorted(code[marks], np.arange(len(vocabulary) + 1))
            owner = np.repeat(np.arange(rows.num_rows), lengths)
            ids = comparable_ids(rows.column("id"))
            open_to = open_rows(asked, rows.column("jurisdictions"))

            for j, codes in enumerate(codes_of_query):
                places = [marks[cuts[c] : cuts[c + 1]] for c in codes]
                if min(p.size for p in places) == 0:
                    continue
                hit = np.ones(rows.num_rows, dtype=bool) if asked[j] is None else open_to[asked[j]].copy()
                for p in places:
                    present = np.zeros(rows.num_rows, dtype=bool)
                    present[owner[p]] = True
                    hit &= present
                if not hit.any():
                    continue
                places = [p[hit[owner[p]]] for p in places]
                score = cover_density(places, ends, begins, cover_length)
                best.add(j, -np.round(score[hit], decimals), ids[hit])

        def emit(best):
            q, names, costs = best.rows()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(q, type=key_type),
                    pa.array(names, type=id_type),
                    pa.array([-c for c in costs], type=pa.float64()),
                ],
                names=["query_id", "id", "score"],
            )

        best = ShortLists(keys, k)
        for batch in batches:
            if batch.num_rows:
                scan(batch, best)
            if k is None:  # everything is wanted: nothing needs to be held back
                yield emit(best)
                best = ShortLists(keys, k)
        yield emit(best)

    def run(batches):
        yield from by_block(blocks, batches, score)

    return run


def matches(
    chunks: DataFrame,
    queries: DataFrame | StoredQueries,
    analyzer: Analyzer = simple,
    k: int | None = None,
    cover_length: int = COVER_LENGTH,
    decimals: int = DECIMALS,
) -> DataFrame:
    """(query_id, id, score) for every searchable chunk holding all terms of a
    query and open to its jurisdiction; with `k`, each task's k best per query."""
    from pyspark.sql.pandas.types import to_arrow_type

    corpus = with_tokens(searchable(chunks), analyzer).select("id", "jurisdictions", "tokens")
    stored = queries if isinstance(queries, StoredQueries) else store_queries(prepared_queries(queries, analyzer))
    kinds = [stored.id_type, corpus.schema["id"].dataType]
    schema = T.StructType(
        [
            T.StructField("query_id", kinds[0]),
            T.StructField("id", kinds[1]),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return corpus.mapInArrow(_cover_kernel(stored, *map(to_arrow_type, kinds), k, cover_length, decimals), schema)


def lexical_top_k(
    chunks: DataFrame,
    queries: DataFrame | StoredQueries,
    k: int = POOL,
    analyzer: Analyzer = simple,
    cover_length: int = COVER_LENGTH,
    decimals: int = DECIMALS,
) -> DataFrame:
    """(query_id, id, score, rank): the k best all-terms matches per query.

    chunks: id, node_type, jurisdictions and either tokens or heading and text.
    Equal scores are ranked by id.
    """
    scored = matches(chunks, queries, analyzer, k, cover_length, decimals)
    return merge_top_k(scored, ["query_id"], "id", [F.col("score").desc(), F.col("id")], k)
