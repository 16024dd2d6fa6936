"""Keyed tables of which a change rewrites only the parts that its keys fall in.

The last bits of a key's hash name its bucket. A bucket is a folder, and the log
lists for every version the folder of each bucket: a change writes new folders for
the buckets it touches and lists the old ones of all others again. A bucket that
has grown past `bucket_rows` is divided by further bits when it is next rewritten,
so buckets keep their size while the table grows. The driver holds a table's list
of buckets, never its keys.

Keys are unique and not null; a change that breaks this fails before it is logged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuskit.operators import merge
from corpuskit.sinks.log import add_entry, last_entry, remove_entries
from corpuskit.sizing import file_system

BUCKET_ROWS = 1_000_000
ENTRY = "bucket long, path string, rows long, key string, bucket_rows long, columns string"


@dataclass(frozen=True)
class Version:
    """What a version of a table consists of. A bucket's number is a one followed by
    its bits; its folder is None while it is empty."""

    number: int
    key: str
    bucket_rows: int
    columns: T.StructType
    buckets: dict[int, tuple[str | None, int]]


def version_of(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The current version, or the one asked for; None before the first write."""
    found, rows = last_entry(spark, f"{root}/_log", ENTRY, number)
    if not rows:
        return None
    first = rows[0]
    columns = T.StructType.fromJson(json.loads(first["columns"]))
    return Version(found, first["key"], first["bucket_rows"], columns, {r["bucket"]: (r["path"], r["rows"]) for r in rows})


def create(rows: DataFrame, root: str, key: str, bucket_rows: int = BUCKET_ROWS) -> int:
    """A new table of `rows` under `root`; its first version's number."""
    spark = rows.sparkSession
    if version_of(spark, root) is not None:
        raise ValueError(f"{root} holds a table already")
    buckets = _divided(1, rows.select(key).count(), bucket_rows)
    columns = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema])
    empty = Version(0, key, bucket_rows, columns, {})
    return _commit(spark, root, empty, _write(_keyed(rows, key), root, key, buckets))


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table as of its current version, or of an earlier one that is still kept."""
    version = _known(spark, root, number)
    return _rows(spark, root, version, version.buckets)


def read_keys(root: str, keys: DataFrame) -> DataFrame:
    """The rows of the named keys. Only the buckets that these fall in are read."""
    spark = keys.sparkSession
    version = _known(spark, root)
    wanted = _typed(keys, version, [version.key]).distinct()
    touched = _placed(wanted, version.key, version.buckets).select("_bucket").distinct().collect()
    return _rows(spark, root, version, [r[0] for r in touched]).join(wanted, version.key, "left_semi")


def upsert(root: str, rows: DataFrame) -> int:
    """`rows` replace the rows with their keys; others are added. Returns the number
    of the version that holds the result."""
    return _change(root, rows, None, lambda old, new, key: (merge.upsert(old, new, key), None), grows=True)


def update(root: str, changes: DataFrame, columns: Sequence[str]) -> int:
    """Sets `columns` of the rows named by key; keys that are not there are ignored.
    An explicit NULL is written."""
    return _change(root, changes, columns, lambda old, new, key: (merge.update_columns(old, new, columns, key), None))


def delete(root: str, keys: DataFrame) -> int:
    return _change(root, keys, [], lambda old, gone, key: (old.join(gone, key, "left_anti"), None))


def repair(root: str, fresh: DataFrame, text: str = "text") -> tuple[int, DataFrame]:
    """(version, changed rows with their old and new text): rows whose stored text is
    a strict prefix of the fresh one get the fresh text (see `merge.repair_truncated`).

    What will change is found by key and text alone, and kept under `_backups`. The
    version is not logged unless as many rows change as were found.
    """
    spark = fresh.sparkSession
    version = _known(spark, root)
    key = version.key
    stored = _rows(spark, root, version, version.buckets).select(key, text)
    new = _typed(fresh, version, [key, text])
    changed = merge.repair_truncated(stored, new, key, text)[1].join(new, key)
    backup = f"{root}/_backups/{uuid.uuid4().hex}"
    changed.write.parquet(backup)
    kept = spark.read.schema(changed.schema).parquet(backup)
    planned = kept.count()

    def repaired(old: DataFrame, longer: DataFrame, key: str):
        rows, _, observed = merge.repair_truncated(old, longer, key, text)
        return rows, lambda: merge.require_changes(observed, planned)

    return _change(root, kept, [text], repaired), kept


def remove_old(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Deletes the folders that none of the newest `keep` versions lists, and returns
    how many. No writer, and no reader of an older version, may be at work. Backups
    stay."""
    last = _known(spark, root).number
    listed = spark.read.schema(f"{ENTRY}, version int").parquet(f"{root}/_log").where(F.col("version") > last - keep)
    used = {r[0] for r in listed.select("path").distinct().collect()}
    remove_entries(f"{root}/_log", last - keep + 1)
    system, place = file_system(root)
    gone = 0
    for write in system.get_file_info(fs.FileSelector(f"{place}/data", allow_not_found=True)):
        parts = [i.base_name for i in system.get_file_info(fs.FileSelector(write.path)) if i.base_name.startswith("_bucket=")]
        unused = [p for p in parts if f"data/{write.base_name}/{p}" not in used]
        for part in unused:
            system.delete_dir(f"{write.path}/{part}")
        if len(unused) == len(parts):
            system.delete_dir(write.path)
        gone += len(unused)
    for info in system.get_file_info(fs.FileSelector(f"{place}/_changes", allow_not_found=True)):
        system.delete_dir(info.path)
    return gone


def _known(spark: SparkSession, root: str, number: int | None = None) -> Version:
    version = version_of(spark, root, number)
    if version is None:
        raise ValueError(f"no such table or version: {root}")
    return version


def _typed(rows: DataFrame, version: Version, names: Sequence[str]) -> DataFrame:
    """Columns in the table's types: a key must hash alike whatever type it arrives in."""
    return rows.select(*[F.col(n).cast(version.columns[n].dataType).alias(n) for n in names])


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    null = F.raise_error(F.lit("a key is null")).cast("boolean")
    return merge.single_rows(rows.where(F.when(F.col(key).isNull(), null).otherwise(F.lit(True))), [key])


def _divided(bucket: int, rows: int, limit: int) -> list[int]:
    """The buckets, of `limit` rows or so, that take the place of one."""
    depth = bucket.bit_length() - 1
    bits = (max(rows - 1, 0) // limit).bit_length()
    return [(1 << depth + bits) | (part << depth) | (bucket - (1 << depth)) for part in range(1 << bits)]


def _placed(rows: DataFrame, key: str, buckets: Iterable[int]) -> DataFrame:
    """`rows` with the number of their bucket. Every row must belong to one."""
    depths = sorted({b.bit_length() - 1 for b in buckets})
    hashed = F.xxhash64(key)
    numbers = [hashed.bitwiseAND(F.lit((1 << d) - 1).cast("long")) + F.lit(1 << d).cast("long") for d in depths]
    if len(numbers) == 1:
        return rows.withColumn("_bucket", numbers[0])
    # The driver holds this list already; a number is eight bytes.
    known = F.broadcast(rows.sparkSession.createDataFrame([(b,) for b in buckets], "_bucket long"))
    return rows.withColumn("_bucket", F.explode(F.array(*numbers))).join(known, "_bucket", "left_semi")


def _rows(spark: SparkSession, root: str, version: Version, buckets: Iterable[int]) -> DataFrame:
    folders = [f"{root}/{version.buckets[b][0]}" for b in buckets if version.buckets[b][0]]
    return spark.read.schema(version.columns).parquet(*folders) if folders else spark.createDataFrame([], version.columns)


def _write(rows: DataFrame, root: str, key: str, buckets: Sequence[int]) -> dict[int, tuple[str | None, int]]:
    """Writes `rows`, which belong to `buckets`; the folder and rows of each."""
    folder = f"data/{uuid.uuid4().hex}"
    _placed(rows, key, buckets).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    # Counted by the files' footers.
    counts = rows.sparkSession.read.schema("_bucket long").parquet(f"{root}/{folder}").groupBy("_bucket").count()
    written = {r[0]: (f"{folder}/_bucket={r[0]}", r[1]) for r in counts.collect()}
    return {b: written.get(b, (None, 0)) for b in buckets}


def _change(root: str, changes: DataFrame, columns: Sequence[str] | None, apply: Callable, grows: bool = False) -> int:
    """Applies `changes` (all columns, or the key and `columns`) to the buckets that
    hold their keys. `apply` takes the rows of these buckets, the changes and the key;
    it returns the new rows and what is to be checked before they are logged."""
    spark = changes.sparkSession
    version = _known(spark, root)
    key = version.key
    names = version.columns.names if columns is None else [key, *columns]
    # Evaluated once, since the buckets must be known before the rows are read.
    stage = f"{root}/_changes/{uuid.uuid4().hex}"
    typed = _keyed(_typed(changes, version, names), key)
    typed.write.parquet(stage)
    staged = spark.read.schema(typed.schema).parquet(stage)

    def by_bucket(keys: DataFrame) -> dict[int, int]:
        return {r[0]: r[1] for r in _placed(keys, key, version.buckets).groupBy("_bucket").count().collect()}

    touched = by_bucket(staged.select(key))
    if touched and not grows:
        there = _rows(spark, root, version, touched).select(key)
        touched = dict.fromkeys(by_bucket(staged.select(key).join(there, key, "left_semi")), 0)
    if not touched:
        return version.number
    buckets = [b for t, more in touched.items() for b in _divided(t, version.buckets[t][1] + more, version.bucket_rows)]
    new, check = apply(_rows(spark, root, version, touched), staged if grows else _within(staged, key, version, touched), key)
    written = _write(new, root, key, buckets)
    if check is not None:
        check()
    kept = {b: place for b, place in version.buckets.items() if b not in touched}
    return _commit(spark, root, version, {**kept, **written})


def _within(staged: DataFrame, key: str, version: Version, touched: Iterable[int]) -> DataFrame:
    """The changes whose bucket is rewritten."""
    wanted = F.broadcast(staged.sparkSession.createDataFrame([(b,) for b in touched], "_bucket long"))
    return _placed(staged, key, version.buckets).join(wanted, "_bucket", "left_semi").drop("_bucket")


def _commit(spark: SparkSession, root: str, version: Version, buckets: dict[int, tuple[str | None, int]]) -> int:
    number = version.number + 1
    entry = [(b, path, rows, version.key, version.bucket_rows, version.columns.json()) for b, (path, rows) in buckets.items()]
    add_entry(spark, f"{root}/_log", ENTRY, number, entry)
    return number
