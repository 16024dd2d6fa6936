"""Approximate dense search by product quantisation.

A vector of length one is cut into parts, and each part is stored as the number of
its nearest centroid: a byte a part, a sixteenth of four-byte numbers where a part
has four of them. The centroids of a part are fitted by k-means on a bounded sample,
the `SAMPLE` rows of smallest id hashes; every vector is stored. A search reads the
codes only: a query's products with all centroids are a small table, and the sum of
its entries at a row's codes is close to their cosine. The best `candidates` rows of
each query are then joined with their vectors and ranked by exact distance, so
distances are exact and only the candidate set is approximate.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuskit.functions.vectors import _dot, norm
from corpuskit.operators.dense import DECIMALS, POOL
from corpuskit.operators.filters import embedded, searchable
from corpuskit.operators.ranking import merge_top_k
from corpuskit.operators.shortlist import ShortLists, comparable_ids, open_rows
from corpuskit.session import shared_folder
from corpuskit.sizing import StoredQueries, block_reader, by_block, store_queries

PARTS = 16
CENTROIDS = 256  # a byte
SAMPLE = 8192  # rows that the centroids are fitted on
ROUNDS = 15
CANDIDATES = 256
STEP_ROWS = 1 << 14


@dataclass(frozen=True)
class Quantised:
    """Stored codes: where, and the centroids, an array of part, number, component."""

    path: str
    centroids: np.ndarray
    width: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def unit_parts(column, parts: int) -> np.ndarray:
    """Vectors of a list column at length one, cut into parts (zeros at the end)."""
    import pyarrow.compute as pc

    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if len(lengths) else 0
    if (lengths != width).any():
        raise ValueError(f"every vector must have {width} values")
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), width).astype(np.float64)
    size = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        rows = np.nan_to_num(rows / size)
    short = -(-width // parts)
    return np.pad(rows, ((0, 0), (0, parts * short - width))).reshape(len(rows), parts, short)


def nearest_centroids(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point; of equally near ones the first."""
    return np.argmin((centroids**2).sum(axis=1) - 2 * points @ centroids.T, axis=1)


def fitted(points: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of points by Lloyd's iterations from a seeded choice of points. A
    centroid without points stays where it is."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.permutation(len(points))[np.arange(CENTROIDS) % len(points)]].copy()
    for _ in range(rounds):
        near = nearest_centroids(points, centroids)
        count = np.bincount(near, minlength=CENTROIDS)
        total = np.stack([np.bincount(near, weights=points[:, i], minlength=CENTROIDS) for i in range(points.shape[1])], axis=1)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def train(vectors: DataFrame, parts: int = PARTS, sample: int = SAMPLE) -> np.ndarray:
    """Centroids by part, each part fitted in a task of its own."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                pieces = unit_parts(batch.column(0), parts)
                flat = pieces.reshape(-1, pieces.shape[2])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), batch.num_rows)), lists], names=["part", "values"])

    def fit(rows):
        import pyarrow as pa

        points = np.array(rows.column("values").to_pylist())
        points = points[np.lexsort(points.T[::-1])]  # the rows of a group come in any order
        return pa.table({"part": rows.column("part").slice(0, 1), "centroids": pa.array([fitted(points).ravel().tolist()])})

    chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding")
    pieces = chosen.mapInArrow(cut, "part int, values array<double>")
    found = pieces.groupBy("part").applyInArrow(fit, "part int, centroids array<double>").orderBy("part").collect()
    return np.array([r["centroids"] for r in found]).reshape(len(found), CENTROIDS, -1) if found else np.zeros((parts, CENTROIDS, 1))


def build(chunks: DataFrame, parts: int = PARTS, sample: int = SAMPLE, path: str | None = None) -> Quantised:
    """Fits centroids and writes (id, jurisdictions, code) of all searchable chunks
    with a vector to `path`, or a new folder in the shared one."""
    spark = chunks.sparkSession
    path = path or f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    corpus = embedded(searchable(chunks)).select("id", "jurisdictions", "embedding")
    centroids = train(corpus, parts, sample)
    held = spark.sparkContext.broadcast(centroids)  # a byte's worth of centroids: 256 vectors in all
    schema = T.StructType([corpus.schema["id"], corpus.schema["jurisdictions"], T.StructField("code", T.BinaryType())])

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                pieces = unit_parts(batch.column(2), parts)
                codes = np.stack([nearest_centroids(pieces[:, p], held.value[p]) for p in range(parts)], axis=1).astype(np.uint8)
                ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts)
                body = pa.Array.from_buffers(pa.binary(), len(codes), [None, ends.buffers()[1], pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], names=["id", "jurisdictions", "code"])

    corpus.mapInArrow(encode, schema).write.parquet(path)
    return Quantised(path, centroids, parts)


def _kernel(held, stored: StoredQueries, key_type, id_type, parts: int, candidates: int):
    """Batch function giving the rows of largest estimated cosine."""
    blocks = block_reader(stored, ["query_id", "qvec", "jurisdiction"])

    def score(block, batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        block = block.filter(pc.is_valid(block.column("qvec")))
        if not block.num_rows:
            return
        centroids = held.value
        keys, asked = block.column("query_id").to_pylist(), block.column("jurisdiction").to_pylist()
        pieces = unit_parts(block.column("qvec"), parts)
        best = ShortLists(keys, candidates)
        for batch in batches:
            for begin in range(0, batch.num_rows, STEP_ROWS):
                rows = batch.slice(begin, STEP_ROWS)
                codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, parts)
                ids = comparable_ids(rows.column("id"))
                open_to = open_rows(asked, rows.column("jurisdictions"))
                for j, jurisdiction in enumerate(asked):
                    table = np.einsum("pcs,ps->pc", centroids, pieces[j]).astype(np.float32)
                    about = np.zeros(rows.num_rows, np.float32)
                    for p in range(parts):
                        about += table[p][codes[:, p]]
                    keep = slice(None) if jurisdiction is None else open_to[jurisdiction]
                    best.add(j, -about[keep].astype(np.float64), ids[keep])
        q, names, costs = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(q, key_type), pa.array(names, id_type), pa.array([-c for c in costs], pa.float64())], names=["query_id", "id", "about"])

    def run(batches):
        yield from by_block(blocks, batches, score)

    return run


def top_k(codes: Quantised, chunks: DataFrame, queries: DataFrame, k: int = POOL, candidates: int = CANDIDATES, decimals: int = DECIMALS) -> DataFrame:
    """(query_id, id, distance, rank): of the `candidates` chunks whose codes are
    nearest to a query, the `k` of smallest exact cosine distance.

    chunks: id and embedding of the stored chunks. queries: query_id, qvec,
    jurisdiction (NULL = no filter). Equal distances are ranked by id.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = chunks.sparkSession
    stored = store_queries(queries.select("query_id", "qvec", "jurisdiction"))
    corpus = codes.read(spark)
    schema = T.StructType([T.StructField("query_id", stored.id_type), corpus.schema["id"], T.StructField("about", T.DoubleType())])
    held = spark.sparkContext.broadcast(codes.centroids)
    near = corpus.mapInArrow(_kernel(held, stored, to_arrow_type(stored.id_type), to_arrow_type(corpus.schema["id"].dataType), codes.width, max(candidates, k)), schema)
    short = merge_top_k(near, ["query_id"], "id", [F.col("about").desc(), F.col("id")], max(candidates, k)).select("query_id", "id")
    asked = spark.read.parquet(stored.path).select("query_id", "qvec")
    exact = short.join(chunks.select("id", "embedding"), "id").join(asked, "query_id")
    lengths = norm("embedding") * norm("qvec")
    cosine = F.try_divide(_dot(F.col("embedding"), F.col("qvec")), lengths)  # a vector without a length has no distance
    ranked = exact.select("query_id", "id", F.round(F.lit(1.0) - cosine, decimals).alias("distance")).where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return merge_top_k(ranked, ["query_id"], "id", [F.col("distance"), F.col("id")], k)
