"""A log of states: every entry is one small file that lists a whole state, so the
last entry is all that a reader needs. Spark publishes the file by a rename, hence
an entry is there in full or not at all."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import Row, SparkSession, functions as F

from corpuskit.sinks.tables import read_if_there
from corpuskit.sizing import file_system


def last_entry(spark: SparkSession, log: str, schema: str, version: int | None = None) -> tuple[int, list[Row]]:
    """(number, rows) of the last entry, or of `version`; (0, []) before the first."""
    entries = read_if_there(spark, log, f"{schema}, writer string, version int")
    if entries is None:
        return 0, []
    number = entries.agg(F.max("version")).first()[0] if version is None else version
    rows = [] if number is None else entries.where(F.col("version") == number).collect()
    if len({r["writer"] for r in rows}) > 1:
        raise RuntimeError(f"two writers wrote version {number} of {log}; remove the file of one of them")
    return number or 0, rows


def add_entry(spark: SparkSession, log: str, schema: str, number: int, rows: list[tuple]) -> None:
    """Writes entry `number`. `rows` must not be empty. One writer at a time: two
    entries of one number are found by the next reader, which fails."""
    entry = spark.createDataFrame(rows, schema).coalesce(1)
    marked = entry.withColumn("writer", F.lit(uuid.uuid4().hex)).withColumn("version", F.lit(number))
    marked.write.mode("append").partitionBy("version").parquet(log)


def remove_entries(log: str, before: int) -> None:
    """Deletes the entries with numbers under `before`."""
    system, place = file_system(log)
    for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        name, _, number = info.base_name.partition("=")
        if name == "version" and int(number) < before:
            system.delete_dir(info.path)
