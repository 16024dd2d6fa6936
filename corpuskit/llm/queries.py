"""The registered queries of the operators, with production parameters over the
whole given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm import collocations, curve_packing, decontamination, domain_score, language_mixture, line_frequency, line_labels, plane_files, simhash, token_counts, tokenizer_alignment, toxicity, vector_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file on this machine and on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_mixture.learn(docs.where(~held_out))
    return language_mixture.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    out = decontamination.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", F.round("score", 6).alias("score"), "first_word", "last_word")


@query
def op3_curve_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = curve_packing.pack(table(spark, sf, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_plane_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    files = plane_files.write(docs, tokenizer_file())
    return plane_files.read(files, docs.schema["doc_id"].dataType.simpleString()).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    pieces = token_counts.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf, "documents"), pieces).withColumn("log_likelihood", F.round("log_likelihood", 6))


@query
def op6_line_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = line_labels.train(docs, table(spark, sf, "labels"))
    return line_labels.label_lines(docs, model).drop("boilerplate_lines")


@query
def op7_line_frequency(spark: SparkSession, sf: str) -> DataFrame:
    out = line_frequency.drop_boilerplate(table(spark, sf, "documents"), F.col("source"))
    return out.select(
        "doc_id",
        F.size("dropped_lines").cast("long").alias("n_dropped"),
        F.array_join(F.col("dropped_lines").cast("array<string>"), ",").alias("dropped"),
        F.length("text").cast("long").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )


SQL["op7_line_frequency"] = rf"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
on_pages AS (
  SELECT DISTINCT source, text, line FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
bad AS (
  SELECT c.source, c.line FROM (SELECT source, line, count(*) AS n FROM on_pages GROUP BY source, line) c
  JOIN totals t ON t.source IS NOT DISTINCT FROM c.source
  WHERE n >= {line_frequency.MIN_PAGES} AND n::DOUBLE / host_pages > {line_frequency.MAX_RATIO}::DOUBLE),
numbered AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
marked AS (
  SELECT n.doc_id, n.pos, n.line, b.line IS NOT NULL AS gone
  FROM numbered n LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM n.source AND b.line = n.line)
SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped,
  coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (WHERE gone), '') AS dropped,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM marked GROUP BY doc_id"""


@query
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op9_domain_score(spark: SparkSession, sf: str) -> DataFrame:
    good = table(spark, sf, "labels").where("quality = 1")
    return domain_score.score(table(spark, sf, "documents"), good)


@query
def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    characters = toxicity.learn_characters(docs)
    model = toxicity.learn(docs.where(~held_out), labels.where(~held_out), characters)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op11_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    a, b = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return tokenizer_alignment.align(table(spark, sf, "documents"), a, b).withColumnRenamed("id", "doc_id")


@query
def op12_vector_join(spark: SparkSession, sf: str) -> DataFrame:
    found = vector_join.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.withColumnRenamed("id", "vec_id")


SQL["op12_vector_join"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS length FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v2 AS (SELECT * FROM v WHERE length > 0),
pairs AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.length * c.length) AS score
  FROM v2 q JOIN v2 c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5"""


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"), top=2000)


SQL["op13_collocations"] = rf"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS parts
  FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, regexp_extract_all(unnest(parts), '[^ 	]+') AS w FROM docs),
numbered AS (SELECT lang, w, row_number() OVER () AS piece FROM pieces WHERE len(w) > 0),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM numbered),
counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, (VALUES (1), (2), (3), (4), (5)) AS sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM numbered GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
hiding AS (
  SELECT DISTINCT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, a FROM (
    SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))),
hidden AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN hiding h ON h.lang = c.lang AND h.phrase = c.phrase WHERE 100 * h.a >= 100 * c.a),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
  WHERE NOT EXISTS (SELECT 1 FROM hidden x WHERE x.lang = c.lang AND x.phrase = c.phrase)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000"""
