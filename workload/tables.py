"""How the given tables stand in for a corpus, in Spark and in SQL.

Both sides apply the same rules to every row: the class of a document is read
off its text, its jurisdiction off its language, and the queries are all
benchmark items.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpuskit.operators import inverted
from corpuskit.sizing import spread
from corpuskit.sources.files import with_vectors

LANGUAGES = ("DE", "ES", "FR")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents with their vectors where they have one."""
    return with_vectors(_texts(spark, sf), _vectors(spark, sf))


def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of `chunks` without their vectors. Where no document has two of them,
    the join would move all texts and change no row."""
    vectors = _vectors(spark, sf)
    several = vectors.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _texts(spark, sf) if several.isEmpty() else chunks(spark, sf).drop("embedding")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    documents = spread(table(spark, sf, "documents"))
    heading = F.split_part("text", F.lit("\n"), F.lit(1))
    text = F.col("text")
    node_type = (
        F.when(F.contains(text, F.lit("|")), "table")
        .when(F.col("n_chars") < 250, "glossary")
        .when(~F.contains(text, F.lit("\n")), "part")
        .otherwise("subclause")
    )
    words = F.split(heading, " ")
    return documents.select(
        F.col("doc_id").alias("id"),
        node_type.alias("node_type"),
        F.when(F.col("n_chars") >= 60, F.concat(F.lit("C"), F.col("n_chars") % 50)).alias("clause_id"),
        F.col("source").alias("doc"),
        heading.alias("heading"),
        "text",
        F.when(F.col("lang") != "en", F.array(F.upper("lang"))).alias("jurisdictions"),
        F.array(F.lower(F.get(words, 0)), F.lower(F.get(words, F.size(words) - 1))).alias("defined_terms"),
    )


_INDEXES: dict[tuple[str, str], inverted.Index] = {}


def text_index(spark: SparkSession, sf: str) -> inverted.Index:
    """The stored index of all chunks: built by the first search of a session, read
    by the others."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = inverted.build(text_chunks(spark, sf))
    return _INDEXES[key]


CHUNKS_SQL = r"""
chunks AS (
  SELECT d.doc_id AS id,
    CASE WHEN contains(text, '|') THEN 'table' WHEN n_chars < 250 THEN 'glossary'
         WHEN NOT contains(text, chr(10)) THEN 'part' ELSE 'subclause' END AS node_type,
    CASE WHEN n_chars >= 60 THEN 'C' || (n_chars % 50) END AS clause_id,
    source AS doc, split_part(text, chr(10), 1) AS heading, text,
    CASE WHEN lang <> 'en' THEN [upper(lang)] END AS jurisdictions,
    [lower(string_split(split_part(text, chr(10), 1), ' ')[1]),
     lower(string_split(split_part(text, chr(10), 1), ' ')[-1])] AS defined_terms,
    e.embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

WORDS = r"[\p{L}\p{N}]+"


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark item asks for its most repeated words of at least three
    letters, one to six of them by turns, with the vector of its own number; every language takes its
    turn as the jurisdiction, after one unfiltered."""
    items = table(spark, sf, "benchmark")
    tokens = items.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))).alias("w"))
    counted = tokens.where(F.length("w") >= 3).groupBy("item_id", "w").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("n"), "w"))
    texts = (
        counted.withColumn("r", rank)
        .where("r <= 1 + item_id % 6")
        .groupBy("item_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), " ").alias("query_text"))
    )
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("qvec"))
    turn = F.element_at(F.array(F.lit(None), *[F.lit(x) for x in LANGUAGES]), (F.col("item_id") % 4 + 1).cast("int"))
    return (
        items.select("item_id")
        .join(texts, "item_id", "left")
        .join(vectors, "item_id", "left")
        .select(
            F.col("item_id").alias("query_id"),
            F.coalesce("query_text", F.lit("")).alias("query_text"),
            "qvec",
            turn.alias("jurisdiction"),
        )
    )


QUERIES_SQL = rf"""
qwords AS (
  SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, w) AS r
  FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM benchmark)
  WHERE length(w) >= 3 GROUP BY item_id, w),
queries AS (
  SELECT b.item_id AS query_id, coalesce(t.query_text, '') AS query_text, e.embedding AS qvec,
    [NULL, 'DE', 'ES', 'FR'][b.item_id % 4 + 1] AS jurisdiction
  FROM benchmark b
  LEFT JOIN (SELECT item_id, string_agg(w, ' ' ORDER BY r) AS query_text FROM qwords WHERE r <= 1 + item_id % 6 GROUP BY item_id) t
    ON t.item_id = b.item_id
  LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""

DENSE_SQL = """
dense AS (
  SELECT query_id, id, distance, rank FROM (
    SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
    FROM (SELECT q.query_id, c.id,
            round(1 - list_cosine_similarity(c.embedding::DOUBLE[], q.qvec::DOUBLE[]), 6) AS distance
          FROM chunks c JOIN queries q ON q.qvec IS NOT NULL AND c.embedding IS NOT NULL
            AND c.node_type <> 'glossary'
            AND (q.jurisdiction IS NULL OR c.jurisdictions IS NULL OR list_contains(c.jurisdictions, q.jurisdiction))))
  WHERE rank <= 50)"""

# Minimal covers: the smallest of the terms' latest positions starts a span, and
# the first row reaching a start ends it.
LEXICAL_SQL = rf"""
qterms AS (
  SELECT query_id, jurisdiction, term, row_number() OVER (PARTITION BY query_id ORDER BY term) AS k,
    count(*) OVER (PARTITION BY query_id) AS n
  FROM (SELECT DISTINCT query_id, jurisdiction, unnest(regexp_extract_all(lower(query_text), '{WORDS}')) AS term FROM queries)),
tokens AS (
  SELECT id, jurisdictions, regexp_extract_all(lower(coalesce(heading, '') || ' ' || text), '{WORDS}') AS tokens
  FROM chunks WHERE node_type <> 'glossary'),
postings AS (
  SELECT id, jurisdictions, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM tokens),
found AS (
  SELECT q.query_id, p.id, q.k, q.n, p.pos FROM postings p JOIN qterms q ON q.term = p.term
  WHERE q.jurisdiction IS NULL OR p.jurisdictions IS NULL OR list_contains(p.jurisdictions, q.jurisdiction)),
matched AS (
  SELECT query_id, id FROM found GROUP BY query_id, id, n HAVING count(DISTINCT k) = n),
latest AS (
  SELECT f.query_id, f.id, f.n, f.pos,
    max(CASE WHEN f.k = t.k THEN f.pos END) OVER (PARTITION BY f.query_id, f.id, t.k ORDER BY f.pos) AS last
  FROM found f SEMI JOIN matched m ON m.query_id = f.query_id AND m.id = f.id
  JOIN qterms t ON t.query_id = f.query_id),
starts AS (
  SELECT query_id, id, pos, min(last) AS start FROM latest GROUP BY query_id, id, n, pos HAVING count(last) = n),
covers AS (
  SELECT query_id, id, start, min(pos) AS stop FROM starts
  GROUP BY query_id, id, start),
density AS (
  SELECT query_id, id, round(sum(least(1.0::DOUBLE, 16.0::DOUBLE / (stop - start + 1))), 6) AS score
  FROM covers GROUP BY query_id, id),
lexical AS (
  SELECT query_id, id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM density)
  WHERE rank <= 50)"""


def fused_sql(top: int) -> str:
    return f"""
fused AS (
  SELECT query_id, id, fused_score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, id) AS rank FROM (
      SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused_score
      FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM lexical)
      GROUP BY query_id, id))
  WHERE rank <= {top})"""


@lru_cache(maxsize=None)
def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"
