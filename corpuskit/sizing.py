"""How the query side of a search reaches the tasks.

Queries are written once to the shared folder. Every task reads them from there,
`BLOCK_ROWS` at a time, and scores its own part of the corpus against each block:
no query passes through the driver, and the plan reads the corpus once, whatever
the number of queries.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from corpuskit.session import shared_folder

BLOCK_ROWS = 4096


def file_system(uri: str):
    """(Arrow file system, path) of a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


@dataclass(frozen=True)
class StoredQueries:
    """Queries in the shared folder: where, and the type of `query_id`."""

    path: str
    id_type: T.DataType
    block_rows: int = BLOCK_ROWS


def store_queries(queries: DataFrame, block_rows: int = BLOCK_ROWS) -> StoredQueries:
    path = f"{shared_folder(queries.sparkSession)}/queries-{uuid.uuid4().hex}"
    queries.hint("rebalance").write.parquet(path)
    return StoredQueries(path, queries.schema["query_id"].dataType, block_rows)


def block_reader(stored: StoredQueries, columns: list[str]) -> Callable[[], Iterator]:
    """A function for tasks that yields the stored queries as Arrow batches of at
    most `block_rows` rows."""
    path, rows = stored.path, stored.block_rows

    def blocks():
        from pyarrow import dataset

        system, root = file_system(path)
        found = dataset.dataset(root, filesystem=system, format="parquet")
        for batch in found.to_batches(columns=columns, batch_size=rows, batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                yield batch

    return blocks


def by_block(blocks: Callable[[], Iterator], batches: Iterator, score: Callable) -> Iterator:
    """Runs `score(block, batches)` for every block of queries. One block streams
    over the task's batches; for more, the task's part of the corpus (one input
    split) is held and gone through again."""
    source = blocks()
    first, second = next(source, None), next(source, None)
    if first is None:
        return
    if second is None:
        yield from score(first, batches)
        return
    held = list(batches)
    for block in (first, second):
        yield from score(block, iter(held))
    for block in source:
        yield from score(block, iter(held))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores is dealt out to all of
    them before costly row work. Large inputs have more splits and stay put."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
