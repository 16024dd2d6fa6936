"""The three parts of the system that work on arriving rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.functions.text import embedding_content, is_blank
from corpuskit.operators.quality import check_settings
from corpuskit.operators.ranking import best_rows
from corpuskit.plans.embed import embed_new
from corpuskit.sinks.runs import add_run, read_runs, runs_of
from corpuskit.sinks.tables import read_if_there


def embed_arrivals(
    chunks: DataFrame, vectors_path: str, checkpoint: str, embed: Callable, model: str, dim: int, with_heading: bool = False
) -> StreamingQuery:
    """Embeds the chunks that have arrived and stops. Limit a batch by the source's
    `maxFilesPerTrigger` or `maxBytesPerTrigger`.

    An id is embedded once. The stream's own state holds the ids it has seen, by key,
    so a batch reads no vectors; a chunk without text is not seen. A batch that is run
    again replaces its folder. A stream that lost its checkpoint starts with empty
    state, under a name of its own: its batches leave out ids that other streams have
    written. Settings that do not fit the stored vectors are refused at the start.
    """
    schema = "id string, embedding array<float>, model string, dim int, with_heading boolean, progress string, epoch long"
    before = read_if_there(chunks.sparkSession, vectors_path, schema)
    if before is not None:
        check_settings(before, model, dim, with_heading)
    content = embedding_content("text", "heading", with_heading)
    fresh = chunks.where(~is_blank(content)).dropDuplicates(["id"])

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        progress = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
        stored = read_if_there(spark, vectors_path, schema)
        # Only folder names are read unless there are other streams.
        done = [] if stored is None else [stored.where(F.col("progress") != progress).select("id")]
        vectors = embed_new(batch, done, embed, model, dim, with_heading)
        vectors.write.mode("overwrite").parquet(f"{vectors_path}/progress={progress}/epoch={epoch}")

    return (
        fresh.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def last_activity(messages: DataFrame) -> DataFrame:
    """Latest message time per conversation, kept up to date. State is one row per
    conversation; set a watermark on `messages` to let old ones go."""
    return messages.groupBy("conversation_id").agg(F.max("created_at").alias("updated_at"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Running counts by reported and corrected status."""
    return feedback.groupBy("reported_status", "corrected_status").agg(F.count(F.lit(1)).alias("n"))


def maintain(
    updates: DataFrame, root: str, checkpoint: str, key: Sequence[str] | None = None, fan: int = 8
) -> StreamingQuery:
    """Keeps the changes of a running aggregate under `root`: each batch writes the
    rows that it changed, and nothing else, to a folder of its own. A batch that is
    run again replaces its folder. `root` belongs to one checkpoint; the current
    rows are those of `read_maintained`.

    With the aggregate's key, batches are sorted runs of which `fan` at a time are
    merged (`sinks.runs`), so that a read touches few runs after any number of them.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        if key:
            add_run(batch, root, epoch, key, fan)
        else:
            batch.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")

    writer = updates.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_maintained(spark: SparkSession, root: str, key: list[str]) -> DataFrame:
    """The last row of every key."""
    if runs_of(spark, root)[1]:
        return read_runs(spark, root, key)
    return best_rows(spark.read.parquet(root), key, F.col("epoch"), "last").drop("epoch")


def to_memory(df: DataFrame, name: str, mode: str) -> StreamingQuery:
    """Runs what is available into an in-memory table; for small reports and tests."""
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
