"""The changes of a stream, kept as sorted runs that are merged as they add up.

Each batch adds a run. Whenever `fan` runs of one level stand side by side, they
become one run of the next level that holds the last row of every key, in key
order. After n batches a reader meets at most (fan - 1) runs on each of
log(n) / log(fan) levels, and a row is written again once a level.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.operators.ranking import best_rows, union_all
from corpuskit.sinks.log import add_entry, last_entry, remove_entries
from corpuskit.sizing import file_system

ENTRY = "first long, past long, level int, path string"
KEPT_ENTRIES = 16


class Run(NamedTuple):
    """The changes of the epochs from `first` to before `past`."""

    first: int
    past: int
    level: int
    path: str


def runs_of(spark: SparkSession, root: str) -> tuple[int, list[Run]]:
    """(number of the log's last entry, runs in the order of their epochs)."""
    number, rows = last_entry(spark, f"{root}/_runs", ENTRY)
    return number, sorted(Run(r["first"], r["past"], r["level"], r["path"]) for r in rows)


def add_run(batch: DataFrame, root: str, epoch: int, key: Sequence[str], fan: int) -> None:
    """Adds the rows that an epoch changed, one a key. An epoch that is run again takes
    the place of its run and of all later ones. Runs are merged before the epoch is
    written, so that a merged run never holds an epoch that may still be run again.
    """
    spark = batch.sparkSession
    number, runs = runs_of(spark, root)
    runs = [r for r in runs if r.past <= epoch]
    while len(runs) >= fan and len({r.level for r in runs[-fan:]}) == 1:
        runs[-fan:] = [_merged(spark, root, runs[-fan:], key)]
    path = f"epoch={epoch}"
    batch.write.mode("overwrite").parquet(f"{root}/{path}")
    add_entry(spark, f"{root}/_runs", ENTRY, number + 1, [*runs, Run(epoch, epoch + 1, 0, path)])
    remove_entries(f"{root}/_runs", number + 1 - KEPT_ENTRIES)


def read_runs(spark: SparkSession, root: str, key: Sequence[str]) -> DataFrame:
    """The last row of every key."""
    return _last_rows(spark, root, runs_of(spark, root)[1], key)


def remove_merged(spark: SparkSession, root: str) -> int:
    """Deletes runs that have gone into others, and returns how many. No reader may be
    at work, nor a stream."""
    number, runs = runs_of(spark, root)
    used = {r.path for r in runs}
    system, place = file_system(root)
    there = [i.base_name for i in system.get_file_info(fs.FileSelector(place)) if i.base_name.startswith("epoch=")]
    there += [f"_merged/{i.base_name}" for i in system.get_file_info(fs.FileSelector(f"{place}/_merged", allow_not_found=True))]
    gone = [path for path in there if path not in used]
    for path in gone:
        system.delete_dir(f"{place}/{path}")
    remove_entries(f"{root}/_runs", number)
    return len(gone)


def _last_rows(spark: SparkSession, root: str, runs: list[Run], key: Sequence[str]) -> DataFrame:
    numbered = [spark.read.parquet(f"{root}/{run.path}").withColumn("_run", F.lit(place)) for place, run in enumerate(runs)]
    return best_rows(union_all(numbered), list(key), F.col("_run"), "last").drop("_run")


def _merged(spark: SparkSession, root: str, runs: list[Run], key: Sequence[str]) -> Run:
    path = f"_merged/{uuid.uuid4().hex}"
    rows = _last_rows(spark, root, runs, key)
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(f"{root}/{path}")
    return Run(runs[0].first, runs[-1].past, runs[0].level + 1, path)
