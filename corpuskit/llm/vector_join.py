"""Nearest vectors by a block matrix join of int8 tiles.

Every vector is scaled to length one and rounded to int8 with a scale of its own;
what the rounding lost is known exactly as a length. Queries are written once to
the shared folder. Every task goes over its rows in groups and multiplies each
group with every block of queries: a tile of whole-number products is a table of
cosines with a proven bound on their error. A row survives for a query when its
cosine may reach the k-th best that the query has so far; only survivors are
computed again in double precision, from the original vectors, and go into the
query's heap. The heaps of all groups are merged in the end. So the result is
exact, recall is one, and the error bounds only decide how much is computed twice.

A task holds one group of rows, one block of queries and a number a query, its
k-th best so far; heaps live for one tile and are given out after it. Equal
vectors of a group are looked at once, with the k + 1 smallest ids among them.

Cosines are summed from the first component to the last. Equal cosines are ordered
by id. Vectors that are null, empty or zero, or hold a null or a component that is
not finite, and rows without an id take no part; rows that repeat an id and vector
count once, no row is a neighbour of its own id, and queries that share an id are
answered together. All vectors must have one width, else the job fails. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuskit.session import shared_folder
from corpuskit.sizing import file_system, spread

QUERY_ROWS = 1024  # queries of a tile
GROUP_BYTES = 1 << 23  # original vectors of a group of rows, in doubles
TILE_ROWS = 2048  # rows of a tile
SURVIVORS = 1 << 14  # pairs computed again at once
SLACK = 4e-6  # for the roundings of the bounds themselves, in single precision
STEPS = 127


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) with vectors of doubles: the rows that a search is about."""
    cast = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return cast.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors of a list column as rows."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if width is None else width
    if (lengths != width).any():
        raise ValueError(f"every vector must have {width} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


class Rounded:
    """Vectors with their int8 codes. With c the codes times their scale, a vector
    of length one is c + r, and `lost` is the length of r: the cosine of two
    differs from the codes' product by at most lost + lost' + lost * lost'."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        # Components whose squares a double cannot hold are scaled by powers of two.
        exponent = np.frexp(np.abs(vectors).max(axis=1))[1]
        exponent[np.abs(exponent) < 400] = 0
        self.ids, self.vectors = ids, np.ldexp(vectors, -exponent[:, None])
        self.lengths = np.sqrt(in_order(self.vectors, self.vectors))
        unit = self.vectors / self.lengths[:, None]
        scale = np.abs(unit).max(axis=1) / STEPS
        codes = np.rint(unit / scale[:, None])
        self.codes, self.scale = codes.astype(np.int8), scale.astype(np.float32)
        self.lost = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)).astype(np.float32)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes. Sums of up to 1,024 of them are whole numbers below
    2^24, which single precision holds exactly."""
    total = None
    for i in range(0, a.shape[1], 1024):
        part = a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
        total = part if total is None else total + part
    return total


def _fewest_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows left when of equal vectors only the k + 1 smallest ids stay, each once."""
    same = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    which = np.unique(same, return_inverse=True)[1]
    order = np.lexsort((ids, which))
    which, ranked = which[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (which[1:] != which[:-1]) | (ranked[1:] != ranked[:-1])
    order, which = order[new], which[new]
    begin = np.searchsorted(which, which)
    return np.sort(order[np.arange(len(order)) - begin <= k])


class Search:
    """A block of queries against groups of rows."""

    def __init__(self, queries: Rounded, k: int):
        self.queries, self.k = queries, k
        self.reach = np.full(len(queries.ids), -np.inf)  # the k-th best cosine so far

    def group(self, rows: Rounded) -> Iterator[tuple[int, int, float]]:
        """(query id, id, cosine) of what may be among a query's k best."""
        heaps: list[list[tuple[float, int]]] = [[] for _ in self.queries.ids]
        for begin in range(0, len(rows.ids), TILE_ROWS):
            self._tile(rows, slice(begin, begin + TILE_ROWS), heaps)
        for query, heap in zip(self.queries.ids.tolist(), heaps):
            for cosine, other in heap:
                yield query, -other, cosine

    def _tile(self, rows: Rounded, part: slice, heaps) -> None:
        asked = self.queries
        ids, lost = rows.ids[part], rows.lost[part]
        about = product(asked.codes, rows.codes[part])
        about *= asked.scale[:, None]
        about *= rows.scale[part]
        # |error| <= lost_q + lost_r (1 + lost_q); the largest lost_q serves all queries.
        margin = lost * (1 + asked.lost.max()) + np.float32(SLACK)
        order = np.argsort(ids, kind="stable")
        from_, to = np.searchsorted(ids[order], asked.ids), np.searchsorted(ids[order], asked.ids, side="right")
        for j in np.flatnonzero(to > from_):
            about[j, order[from_[j] : to[j]]] = -np.inf  # no neighbour of its own id
        fresh = np.flatnonzero(np.isneginf(self.reach))
        floor = self.reach.copy()
        if len(fresh):
            # The k-th highest lower bound is a bar as well. An id counts once.
            least = about[fresh] - margin
            ranked = ids[order]
            least[:, order[1:][ranked[1:] == ranked[:-1]]] = -np.inf
            if least.shape[1] >= self.k:
                floor[fresh] = np.partition(least, -self.k, axis=1)[:, -self.k] - asked.lost[fresh]
        about += margin
        q, r = np.nonzero((about >= (floor - asked.lost - SLACK)[:, None].astype(np.float32)) & (about > -2))
        self._exact(q, np.arange(len(rows.ids))[part][r], rows, heaps)

    def _exact(self, q: np.ndarray, r: np.ndarray, rows: Rounded, heaps) -> None:
        asked, k = self.queries, self.k
        for i in range(0, len(q), SURVIVORS):
            one, other = q[i : i + SURVIVORS], r[i : i + SURVIVORS]
            cosine = in_order(asked.vectors[one], rows.vectors[other]) / (asked.lengths[one] * rows.lengths[other])
            good = cosine >= self.reach[one]
            for j, score, name in zip(one[good].tolist(), cosine[good].tolist(), rows.ids[other[good]].tolist()):
                entry, heap = (score, -name), heaps[j]
                if len(heap) < k:
                    if entry not in heap:
                        heapq.heappush(heap, entry)
                elif entry > heap[0] and entry not in heap:
                    heapq.heapreplace(heap, entry)
            for j in np.unique(one).tolist():
                if len(heaps[j]) == k:
                    self.reach[j] = max(self.reach[j], heaps[j][0][0])


def _stored_blocks(path: str):
    """A function for tasks that yields the stored queries in blocks."""

    def read() -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset

        system, root = file_system(path)
        found = dataset.dataset(root, filesystem=system, format="parquet")
        for batch in found.to_batches(columns=["id", "vector"], batch_size=QUERY_ROWS, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield batch

    return read


def _rounded(batch: pa.RecordBatch, width: int | None = None) -> Rounded:
    return Rounded(batch.column(0).to_numpy(), _matrix(batch.column(1), width))


def _groups(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[Rounded]:
    """Rows in groups of about `GROUP_BYTES`."""
    held, size = [], 0
    for batch in batches:
        for begin in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(begin, TILE_ROWS)
            held.append(part)
            size += len(part.column(1).flatten()) * 8
            if size >= GROUP_BYTES:
                yield _group(held, k)
                held, size = [], 0
    if held:
        yield _group(held, k)


def _group(held: list[pa.RecordBatch], k: int) -> Rounded:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, vectors = table.column(0).to_numpy(), _matrix(table.column(1).chunk(0))
    kept = _fewest_copies(ids, vectors, k)
    return Rounded(ids[kept], vectors[kept])


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the `k` vectors of largest cosine for each row
    where `is_query` holds, among all rows of other ids; all of them, if fewer."""
    spark = vectors.sparkSession
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    taking_part(vectors.where(is_query), id_col, vector_col).distinct().hint("rebalance").write.parquet(path)
    blocks = _stored_blocks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach: list[np.ndarray] = []  # of every block of queries, over the groups so far
        for rows in _groups(batches, k):
            for i, block in enumerate(blocks()):
                search = Search(_rounded(block, rows.vectors.shape[1]), k)
                if i < len(reach):
                    search.reach = reach[i]
                else:
                    reach.append(search.reach)
                found = list(search.group(rows))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["query_id", "id", "score"])

    pairs = spread(taking_part(vectors, id_col, vector_col)).mapInArrow(run, "query_id long, id long, score double")
    # One exchange serves both the copies of a row in two groups and the ranks.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = pairs.repartition("query_id").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
