"""Dense search: exact cosine top-k for a batch of queries, and a bucketed
approximate form.

One pass over the corpus. Every task scores its Arrow batches against each block
of stored queries with one matrix product and keeps its own top-k per query; the
short lists are then merged. Top-k of the union of per-task top-k lists is the
global top-k, so the result is exact and the shuffle carries only short lists.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from corpuskit.operators.filters import searchable
from corpuskit.operators.ranking import merge_top_k
from corpuskit.operators.shortlist import ShortLists, comparable_ids, open_rows
from corpuskit.sizing import StoredQueries, block_reader, by_block, store_queries

POOL = 50
DECIMALS = 6  # distances are compared at this precision so that ties are repeatable


CELLS_PER_STEP = 1_000_000  # rows x queries scored at once inside a task: two arrays of 8 MB


def _kernel(stored: StoredQueries, key_type, id_type, k: int, decimals: int, with_cells: bool):
    """Batch function scoring (id, jurisdictions, embedding[, cell]) rows."""
    blocks = block_reader(stored, ["query_id", "qvec", "jurisdiction"] + (["probes"] if with_cells else []))

    def score(block, batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        block = block.filter(pc.is_valid(block.column("qvec")))
        if not block.num_rows:
            return
        keys, asked = block.column("query_id").to_pylist(), block.column("jurisdiction").to_pylist()
        width = pc.list_value_length(block.column("qvec"))[0].as_py()
        flat = block.column("qvec").flatten().to_numpy(zero_copy_only=False)
        if flat.size != len(keys) * width:
            raise ValueError(f"every query vector must have {width} values")
        matrix = flat.reshape(len(keys), width).astype(np.float64)
        probes = block.column("probes").to_pylist() if with_cells else None
        norms = np.sqrt((matrix**2).sum(axis=1))
        best = ShortLists(keys, k)

        def scan(rows):
            flat = rows.column("embedding").flatten().to_numpy(zero_copy_only=False)
            if flat.size != rows.num_rows * width:
                raise ValueError(f"every embedding must have {width} values")
            body = flat.reshape(rows.num_rows, width).astype(np.float64)
            lengths = np.sqrt((body**2).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = body @ matrix.T
                distance /= np.outer(lengths, norms)
                np.subtract(1.0, distance, out=distance)
                np.round(distance, decimals, out=distance)
                distance += 0.0
            ids = comparable_ids(rows.column("id"))
            open_to = open_rows(asked, rows.column("jurisdictions"))
            cells = rows.column("cell").to_numpy(zero_copy_only=False) if with_cells else None
            for j, jurisdiction in enumerate(asked):
                keep = np.isfinite(distance[:, j])
                if jurisdiction is not None:
                    keep &= open_to[jurisdiction]
                if with_cells:
                    keep &= np.isin(cells, probes[j])
                best.add(j, distance[keep, j], ids[keep])

        step = max(1, CELLS_PER_STEP // len(keys))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                scan(batch.slice(start, step))

        q, names, costs = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, type=key_type), pa.array(names, type=id_type), pa.array(costs, type=pa.float64())],
            names=["query_id", "id", "distance"],
        )

    def run(batches):
        yield from by_block(blocks, batches, score)

    return run


def _score(chunks: DataFrame, stored: StoredQueries, k: int, decimals: int, with_cells: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = ["id", "jurisdictions", "embedding"] + (["cell"] if with_cells else [])
    corpus = chunks.where(F.col("embedding").isNotNull()).select(*columns)
    schema = T.StructType(
        [
            T.StructField("query_id", stored.id_type),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    kernel = _kernel(stored, to_arrow_type(stored.id_type), to_arrow_type(corpus.schema["id"].dataType), k, decimals, with_cells)
    return corpus.mapInArrow(kernel, schema)


def _stored(queries: DataFrame | StoredQueries, *columns: str) -> StoredQueries:
    return queries if isinstance(queries, StoredQueries) else store_queries(queries.select("query_id", "qvec", "jurisdiction", *columns))


def dense_top_k(chunks: DataFrame, queries: DataFrame | StoredQueries, k: int = POOL, decimals: int = DECIMALS) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest searchable chunks per query.

    chunks: id, node_type, jurisdictions, embedding. queries: query_id, qvec,
    jurisdiction (NULL = no filter). Equal distances are ranked by id.
    """
    scored = _score(searchable(chunks), _stored(queries), k, decimals, with_cells=False)
    return merge_top_k(scored, ["query_id"], "id", [F.col("distance"), F.col("id")], k)


# -- approximate form -----------------------------------------------------------

def hyperplanes(dim: int, bits: int, seed: int = 7) -> list[list[float]]:
    """Seeded random directions; `bits` of them give 2**bits cells."""
    return np.random.default_rng(seed).standard_normal((bits, dim)).tolist()


def _signature(vector, planes):
    from corpuskit.functions.vectors import _dot

    cell = F.lit(0)
    for bit, plane in enumerate(planes):
        direction = F.array(*[F.lit(float(x)) for x in plane])
        cell = cell + F.when(_dot(vector, direction) >= 0, F.lit(1 << bit)).otherwise(F.lit(0))
    return cell


def with_cells(chunks: DataFrame, planes: list[list[float]]) -> DataFrame:
    """Adds `cell`. Write the result partitioned by `cell`: a probe then reads
    only the cells it names."""
    return chunks.withColumn("cell", F.when(F.col("embedding").isNotNull(), _signature(F.col("embedding"), planes)))


def approximate_top_k(
    cells: DataFrame, queries: DataFrame, planes: list[list[float]], k: int = POOL, flips: int = 1
) -> DataFrame:
    """Cosine top-k among the cells within `flips` sign changes of the query's
    own cell. Scores are exact; only the candidate set is approximate."""
    bits = len(planes)
    masks = [0]
    for _ in range(flips):
        masks = sorted({m ^ (1 << b) for m in masks for b in range(bits)} | set(masks))
    home = queries.where(F.col("qvec").isNotNull()).withColumn("_home", _signature(F.col("qvec"), planes))
    near = F.array(*[F.col("_home").bitwiseXOR(F.lit(m)) for m in masks])
    probing = home.withColumn("probes", near).drop("_home")
    # At most 2**bits values: a literal list prunes partitions of the cell table.
    read = [r[0] for r in probing.select(F.explode("probes")).distinct().limit(1 << bits).collect()]
    pruned = searchable(cells).where(F.col("cell").isin(read))
    scored = _score(pruned, _stored(probing, "probes"), k, DECIMALS, with_cells=True)
    return merge_top_k(scored, ["query_id"], "id", [F.col("distance"), F.col("id")], k)
