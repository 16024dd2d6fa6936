"""Structured documents, page layouts and streams made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuskit.operators.chunking import build_chunks
from corpuskit.operators.layout import page_captions
from corpuskit.operators.scorers import hashed_embedding
from corpuskit.session import shared_folder, stored
from corpuskit.sizing import spread
from corpuskit.sources.structured import parse_documents
from corpuskit.streaming import jobs
from workload.registry import query
from workload.table_queries import hashed_vectors_sql, hundredths
from workload.tables import table

BAD = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _xml(spark, sf):
    """Every document as an XML file: a part with one clause, a subclause per line."""
    d = spread(table(spark, sf, "documents"))
    safe = F.regexp_replace("text", BAD, " ")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(entity))
    key = F.col("doc_id").cast("string")
    lines = F.transform(
        F.split(safe, "\n"),
        lambda line, i: F.concat(
            F.lit('<subclause id="_d'), key, F.lit("-"), i, F.lit('" num="'), i, F.lit('"><content><p>'), line, F.lit("</p></content></subclause>")
        ),
    )
    body = F.concat(
        F.lit('<standard publishing-id="'), "source", F.lit('"><part id="_p'), key, F.lit('" num="P"><title>'), "lang", F.lit('</title><clause id="_c'), key,
        F.lit('" building="Class '), F.col("n_chars") % 10, F.lit('"><sptc>C'), key, F.lit("</sptc><title>T</title>"), F.array_join(lines, ""),
        F.lit("</clause></part></standard>"),
    )
    return d.select(key.alias("corpus"), "source", body.alias("content"))


@query(
    rf"""WITH lines AS (SELECT doc_id, source, lang, n_chars, unnest(string_split(regexp_replace(text, '{BAD}', ' ', 'g'), chr(10))) AS line,
      unnest(range(len(string_split(regexp_replace(text, '{BAD}', ' ', 'g'), chr(10))))) AS i FROM documents)
    SELECT 'd' || doc_id || '-' || i AS id, 'subclause' AS node_type, 'C' || doc_id AS clause_id, source || ' > P ' || lang || ' > C' || doc_id || ' > C' || doc_id || '(' || i || ')' AS path,
      md5(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS text_md5, CAST(n_chars % 10 AS VARCHAR) AS classes FROM lines
    UNION ALL SELECT 'p' || doc_id, 'part', 'P', source, md5(lang), '' FROM documents"""
)
def structured_chunks(spark, sf):
    documents = _xml(spark, sf)
    corpora = documents.select("corpus", F.col("source").alias("doc_label"), F.col("corpus").cast("int").alias("corpus_ord"))
    nodes = stored(parse_documents(documents, corpora))
    images = spark.createDataFrame([], "corpus string, filename string")
    return build_chunks(nodes, images).select(
        "id", "node_type", "clause_id", F.array_join("hierarchy", " > ").alias("path"), F.md5("text").alias("text_md5"), F.array_join("building_classes", ",").alias("classes")
    )


# Orders are images on a page, their lines text blocks around them.
@query(
    """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS block_ord, l_partkey AS k, l_quantity * 12 AS y0, l_quantity * 12 + 10 AS y1, l_discount * 3000 AS x0, l_discount * 3000 + 120 AS x1,
      l_returnflag = 'A' AS cap, CASE WHEN l_returnflag = 'A' THEN 'Figure ' || l_partkey || ': part' ELSE 'Words on ' || l_partkey END AS text FROM lineitem),
    g AS (SELECT o_orderkey AS doc_id, b.*, CASE WHEN y0 >= 300 THEN y0 - 300 WHEN y1 <= 200 THEN 200 - y1 END AS gap, y0 >= 300 AS below
      FROM orders JOIN b ON b.doc_id = o_orderkey WHERE least(x1, 250) - greatest(x0, 50) >= 50),
    c AS (SELECT doc_id, block_ord, k, text, CASE WHEN cap THEN CASE WHEN gap <= 120 THEN 0.75 ELSE 0.4 END WHEN below AND gap <= 40 THEN 0.4 END AS confidence
      FROM g WHERE gap <= CASE WHEN below THEN 140 ELSE 80 END)
    SELECT doc_id, text, confidence::DOUBLE AS confidence FROM c WHERE confidence IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, block_ord, k, text) = 1"""
)
def nearest_captions(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    # Lines of an order may share a number; blocks need an order of their own.
    blocks = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.struct("l_linenumber", "l_partkey").alias("block_ord"),
        (F.col("l_discount") * 3000).alias("x0"), (F.col("l_quantity") * 12).alias("y0"), (F.col("l_discount") * 3000 + 120).alias("x1"), (F.col("l_quantity") * 12 + 10).alias("y1"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Figure "), "l_partkey", F.lit(": part"))).otherwise(F.concat(F.lit("Words on "), "l_partkey")).alias("text"),
        F.lit(0).alias("block_type"),
    )
    images = o.select(
        F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit("img").alias("image_id"), F.lit(50.0).alias("x0"), F.lit(200.0).alias("y0"), F.lit(250.0).alias("x1"), F.lit(300.0).alias("y1")
    )
    return page_captions(images, blocks).select("doc_id", "text", "confidence")


def _stream(spark, sf, name, *columns, parts=4):
    """The table as a stream of several batches: written in parts, one part a batch."""
    folder = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    rows = table(spark, sf, name).select(*columns)
    rows.repartition(parts, F.col(columns[0])).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _maintained(spark, updates, key):
    """Two runs make one, so that a few batches reach three levels."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.maintain(updates, f"{base}/table", f"{base}/progress", key, fan=2).awaitTermination()
    return jobs.read_maintained(spark, f"{base}/table", key)


@query("SELECT conv_id AS conversation_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id")
def stream_last_activity(spark, sf):
    # Dealt by turn, so that later batches move conversations on.
    rows = _stream(spark, sf, "conversations", "turn", "conv_id").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"))
    return _maintained(spark, jobs.last_activity(rows), ["conversation_id"])


@query("SELECT event_type AS reported_status, value > 50 AS corrected_status, count(*) AS n FROM events GROUP BY ALL")
def stream_feedback_counts(spark, sf):
    rows = _stream(spark, sf, "events", "event_id", "event_type", "value").select(F.col("event_type").alias("reported_status"), (F.col("value") > 50).alias("corrected_status"))
    return _maintained(spark, jobs.feedback_counts(rows), ["reported_status", "corrected_status"])


@query(hashed_vectors_sql(key="CAST(doc_id AS VARCHAR)"))
def stream_embedding(spark, sf):
    """Documents arrive in parts, the labelled ones a second time in later parts; each
    is embedded once."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("heading"))
    again = rows.join(table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id")), "id", "left_semi")
    rows.repartition(3).write.parquet(f"{base}/arrivals")
    again.repartition(2).write.mode("append").parquet(f"{base}/arrivals")
    arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrivals")
    jobs.embed_arrivals(arrivals, f"{base}/vectors", f"{base}/progress", hashed_embedding(64), "hashed", 64).awaitTermination()
    return spark.read.parquet(f"{base}/vectors").select("id", "dim", hundredths("embedding").alias("vector"))


@query("SELECT user_id, event_type, count(*) AS n, sum(CAST(floor(value * 100) AS BIGINT)) AS hundredths FROM events GROUP BY ALL")
def stream_merged_runs(spark, sf):
    """Running totals by user and type over nine batches, whose runs are merged by twos."""
    rows = _stream(spark, sf, "events", "event_id", "user_id", "event_type", "value", parts=9)
    totals = rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("hundredths"))
    return _maintained(spark, totals, ["user_id", "event_type"])
