"""Table writes. A table is a folder of versions and a log of which one is
current: a version is written in full before it is logged, so a reader never
sees half a table and a failed job changes nothing."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.sizing import file_system

LOG = "_log"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at `path`, or None before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, root: str) -> str | None:
    """Name of the last version logged. The log is a table of one row per version."""
    log = read_if_there(spark, f"{root}/{LOG}", "version string")
    return log.agg(F.max("version")).first()[0] if log is not None else None


def read_table(spark: SparkSession, root: str) -> DataFrame | None:
    version = current_version(spark, root)
    return spark.read.parquet(f"{root}/{version}") if version else None


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Writes `df` as a new version and makes it current. `df` may read the
    version it replaces. One writer at a time; old versions stay until
    `remove_old_versions`."""
    spark = df.sparkSession
    last = current_version(spark, root)
    number = int(last.split("-")[1]) + 1 if last else 1
    version = f"v-{number:012d}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{root}/{LOG}")
    return version


def remove_old_versions(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Deletes all but the newest `keep` versions and returns their names. Readers of
    a version that goes must be done."""
    log = read_if_there(spark, f"{root}/{LOG}", "version string")
    names = sorted(r[0] for r in log.select("version").distinct().collect()) if log is not None else []
    system, place = file_system(root)
    there = {info.base_name for info in system.get_file_info(fs.FileSelector(place))} if names else set()
    gone = [n for n in names[: max(len(names) - keep, 0)] if n in there]
    for name in gone:
        system.delete_dir(f"{place}/{name}")
    return gone


def append(df: DataFrame, path: str) -> None:
    """Append-only log."""
    df.write.mode("append").parquet(path)


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Chunk files, one folder per document. Working columns are left out."""
    working = [c for c in ("corpus", "pre", "builder") if c in chunks.columns]
    chunks.drop(*working).write.mode("overwrite").partitionBy("doc").format(fmt).save(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_index(descriptions: DataFrame, path: str, key: str = "image", text: str = "description") -> None:
    """Flat index, sorted by key, one {key, text} record per line."""
    descriptions.select(key, text).orderBy(key).write.mode("overwrite").json(path)


def feedback_rows(flags: DataFrame) -> DataFrame:
    """Feedback as it is appended: a fresh id and the time of the write."""
    optional = [c for c in ("doc", "corrected_status", "comment") if c not in flags.columns]
    for name in optional:
        flags = flags.withColumn(name, F.lit(None).cast("string"))
    return flags.select(
        F.expr("uuid()").alias("id"), "clause_id", "doc", "query", "reported_status", "corrected_status", "comment",
        F.current_timestamp().alias("created_at"),
    )
