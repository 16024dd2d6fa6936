"""Loading, merging, references, conversations, workspace, quality, review, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuskit.operators import conversations, evaluation, merge, quality, review, workspace
from corpuskit.operators.filters import split_requests
from corpuskit.operators.ranking import best_rows, union_all
from corpuskit.operators.references import page_links, resolve_links
from corpuskit.operators.scorers import hashed_embedding
from corpuskit.plans import load
from corpuskit.plans.backfill import keyed_descriptions, match_figures
from corpuskit.plans.embed import embed_new, plan_summary, to_embed
from corpuskit.schemas import CHUNK_FILE
from corpuskit.session import shared_folder
from corpuskit.sinks import buckets
from corpuskit.sizing import spread
from corpuskit.functions.text import model_role
from workload.registry import query
from workload.search_queries import RETRIEVED, retrieved
from workload.tables import CHUNKS_SQL, WORDS, chunks, queries, table, with_ctes

C = CHUNKS_SQL

# Two chunk files: all documents, then the good ones again under a new heading.
RECORDS_SQL = """
records AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, NULL AS node_type, source AS heading, text, lang, 0 AS file_ord FROM documents
  UNION ALL
  SELECT CAST(d.doc_id AS VARCHAR), 'subclause', d.source || '/2', CASE WHEN l.toxic = 1 THEN NULL ELSE d.text END, d.lang, 1
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1),
table_rows AS (
  SELECT id, coalesce(node_type, 'clause') AS node_type, heading, coalesce(text, '') AS text, CASE WHEN lang <> 'en' THEN upper(lang) END AS jurisdictions, file_ord FROM records),
unique_rows AS (SELECT * FROM table_rows QUALIFY row_number() OVER (PARTITION BY id ORDER BY file_ord DESC) = 1)"""


def records(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    again = d.join(labels.where("quality = 1"), "doc_id").select(
        "doc_id", F.lit("subclause").alias("node_type"), F.concat("source", F.lit("/2")).alias("heading"),
        F.when(F.col("toxic") != 1, F.col("text")).alias("text"), "lang", F.lit(1).alias("file_ord"),
    )
    first = d.select("doc_id", F.lit(None).cast("string").alias("node_type"), F.col("source").alias("heading"), "text", "lang", F.lit(0).alias("file_ord"))
    rows = union_all([first, again]).withColumn("id", F.col("doc_id").cast("string")).withColumn(
        "jurisdictions", F.when(F.col("lang") != "en", F.array(F.upper("lang"))).otherwise(F.array().cast("array<string>"))
    )
    for field in CHUNK_FILE:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return rows.select(*CHUNK_FILE.names, "file_ord", F.lit(0).alias("row_ord"))


def _row_view(df):
    return df.select("id", "node_type", "heading", F.md5("text").alias("text_md5"), F.array_join("jurisdictions", "|").alias("jurisdictions"))


@query(f"WITH {RECORDS_SQL} SELECT id, node_type, heading, md5(text) AS text_md5, jurisdictions FROM table_rows")
def record_to_row(spark, sf):
    return _row_view(load.to_rows(records(spark, sf), "v1"))


@query(f"WITH {RECORDS_SQL} SELECT id, node_type, heading, md5(text) AS text_md5, jurisdictions FROM unique_rows")
def dedupe_last_wins(spark, sf):
    return _row_view(load.deduplicate(load.to_rows(records(spark, sf), "v1")))


@query("SELECT text_md5, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_md5, doc_id FROM documents) GROUP BY text_md5")
def dedupe_first_wins(spark, sf):
    d = table(spark, sf, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    return best_rows(d, ["text_md5"], F.col("doc_id"), "first")


@query(
    f"""WITH {RECORDS_SQL} SELECT (SELECT count(*) FROM records) AS records_read, count(*) AS rows_to_write, count(*) FILTER (id::BIGINT % 3 = 0) AS figures_with_refs,
    count(*) FILTER (id::BIGINT % 4 = 0) AS rows_with_embedding, (SELECT count(*) FROM records) - count(*) AS duplicates_collapsed FROM unique_rows"""
)
def load_summary(spark, sf):
    key = F.col("id").cast("long")
    figure = F.struct("id", F.concat("id", F.lit(".png")), F.lit("a figure"), F.lit(False))
    r = records(spark, sf)
    r = r.withColumn("image_refs", F.when(key % 3 == 0, F.array(figure)).cast(r.schema["image_refs"].dataType))
    r = r.withColumn("embedding", F.when(key % 4 == 0, F.array(F.lit(0.5).cast("float"))))
    return load.load_summary(r, load.deduplicate(load.to_rows(r, "v1")))


@query(
    f"""WITH {RECORDS_SQL} SELECT id, count(*) AS copies, count(DISTINCT text) = 1 AND count(text) = count(*) AS identical FROM records GROUP BY id HAVING count(*) > 1"""
)
def duplicate_audit(spark, sf):
    return quality.duplicate_audit(records(spark, sf), "id", ["text"])


@query("SELECT md5(text) AS text_md5, count(*) AS copies, count(DISTINCT lang) = 1 AS identical FROM documents GROUP BY 1 HAVING count(*) > 1")
def copied_documents(spark, sf):
    d = table(spark, sf, "documents").withColumn("text_md5", F.md5("text"))
    return quality.duplicate_audit(d, "text_md5", ["lang"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders
    WHERE o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT'"""
)
def upsert_merge(spark, sf):
    o = table(spark, sf, "orders")
    base = o.where("o_orderstatus <> 'O'").select("o_orderkey", "o_totalprice")
    delta = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return merge.upsert(base, delta, "o_orderkey")


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
    FROM orders WHERE (o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT') AND o_orderstatus <> 'P'"""
)
def bucketed_changes(spark, sf):
    """A stored table by key buckets: upserted, updated with NULLs and deleted from."""
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    root = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    buckets.create(o.where("o_orderstatus <> 'O'").select("o_orderkey", "o_totalprice"), root, "o_orderkey", bucket_rows=10_000)
    buckets.upsert(root, o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", (price * 2).alias("o_totalprice")))
    buckets.update(root, o.where("o_orderpriority = '5-LOW'").select("o_orderkey", F.lit(None).alias("o_totalprice")), ["o_totalprice"])
    buckets.delete(root, o.where("o_orderstatus = 'P'").select("o_orderkey"))
    return buckets.read(spark, root)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice ELSE o_totalprice * 2 END AS o_totalprice FROM orders
    WHERE o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT'"""
)
def insert_ignore(spark, sf):
    o = table(spark, sf, "orders")
    base = o.where("o_orderstatus <> 'O'").select("o_orderkey", "o_totalprice")
    delta = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return merge.insert_ignore(base, delta, "o_orderkey")


@query(
    """SELECT o.o_orderkey, CASE WHEN l.k IS NULL THEN o.o_totalprice ELSE l.price END AS o_totalprice FROM orders o
    LEFT JOIN (SELECT l_orderkey AS k, CASE WHEN count(*) > 5 THEN NULL ELSE max(l_extendedprice) END AS price FROM lineitem GROUP BY l_orderkey) l ON l.k = o.o_orderkey"""
)
def keyed_update(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(F.count(F.lit(1)) <= 5, F.max("l_extendedprice")).alias("o_totalprice")
    )
    return merge.update_columns(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_totalprice"], "o_orderkey")


DOOMED = "SELECT n_nationkey FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_name = 'ASIA'"


def _doomed(spark, sf):
    asia = table(spark, sf, "region").where("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    return table(spark, sf, "nation").join(asia, "n_regionkey", "left_semi").select("n_nationkey")


@query(f"SELECT c_custkey, CASE WHEN c_nationkey NOT IN ({DOOMED}) THEN c_nationkey END AS c_nationkey FROM customer")
def delete_set_null(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return merge.delete_set_null(table(spark, sf, "nation"), customers, _doomed(spark, sf), "n_nationkey", "c_nationkey")[1]


@query(f"SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN ({DOOMED})")
def delete_cascade(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    kept = merge.delete_cascade(table(spark, sf, "nation"), customers, _doomed(spark, sf), "n_nationkey", "c_nationkey")[1]
    return kept.select("c_custkey", "c_nationkey")


# Stored texts were cut at their first full stop, or rewritten, for labelled documents.
STORED_SQL = """stored AS (SELECT d.doc_id AS id, d.text AS fresh, CASE WHEN l.quality = 0 THEN split_part(d.text, '.', 1) WHEN l.toxic = 1 THEN 'x' || d.text ELSE d.text END AS text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _stored(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    text = F.when(F.col("quality") == 0, F.split_part("text", F.lit("."), F.lit(1))).when(F.col("toxic") == 1, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    return d.select(F.col("doc_id").alias("id"), text.alias("text"))


@query(f"WITH {STORED_SQL} SELECT id, md5(CASE WHEN starts_with(fresh, text) THEN fresh ELSE text END) AS text_md5 FROM stored")
def guarded_repair(spark, sf):
    fresh = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return merge.repair_truncated(_stored(spark, sf), fresh)[0].select("id", F.md5("text").alias("text_md5"))


@query(f"WITH {STORED_SQL} SELECT id, md5(CASE WHEN starts_with(fresh, text) THEN fresh ELSE text END) AS text_md5 FROM stored")
def bucketed_repair(spark, sf):
    root = f"{shared_folder(spark)}/buckets-{uuid.uuid4().hex}"
    buckets.create(_stored(spark, sf), root, "id", bucket_rows=500)
    buckets.repair(root, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    return buckets.read(spark, root).select("id", F.md5("text").alias("text_md5"))


@query(
    """SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events
    WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 70) GROUP BY user_id"""
)
def error_compaction(spark, sf):
    e = table(spark, sf, "events")
    errors = e.where("event_type = 'error'").select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"))
    done = e.where("event_type = 'purchase' AND value > 70").select("user_id")
    return merge.outstanding_errors(errors, done, "user_id", "at").drop("at")


@query("SELECT doc_id AS id FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def resume_antijoin(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("heading"))
    return to_embed(d, [table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))]).select("id")


@query(
    """SELECT CASE WHEN e.vec_id IS NOT NULL THEN 'done' WHEN trim(text) = '' THEN 'blank' ELSE 'to_embed' END AS state, count(*) AS chunks
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1"""
)
def embedding_plan(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("heading"))
    return plan_summary(d, [table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))])


@query("SELECT 'model-' || label % 3 AS model, len(embedding) AS dim, vec_id % 2 = 0 AS with_heading, count(*) AS vectors FROM embeddings GROUP BY ALL")
def settings_in_use(spark, sf):
    v = table(spark, sf, "embeddings").select(F.size("embedding").cast("long").alias("dim"), F.concat(F.lit("model-"), F.col("label") % 3).alias("model"), (F.col("vec_id") % 2 == 0).alias("with_heading"))
    return quality.settings_in_use(v).select("model", "dim", "with_heading", "vectors")


def hundredths(vector):
    return F.array_join(F.transform(vector, lambda x: F.floor(x.cast("double") * 100 + 0.3137).cast("string")), ",")


def hashed_vectors_sql(condition: str = "true", key: str = "doc_id") -> str:
    """The offline embedding of the documents with text, in hundredths."""
    return f"""WITH words AS (SELECT {key} AS id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS slot FROM (
      SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM documents WHERE trim(text) <> '' AND {condition})),
    counts AS (SELECT id, slot, count(*)::DOUBLE AS n FROM words GROUP BY id, slot),
    norms AS (SELECT id, sqrt(sum(n * n)) AS norm FROM counts GROUP BY id),
    slots AS (SELECT n.id, s.slot, coalesce(c.n, 0) / n.norm AS x FROM norms n JOIN (SELECT unnest(range(64)) AS slot) s ON true LEFT JOIN counts c ON c.id = n.id AND c.slot = s.slot)
    SELECT id, 64 AS dim, string_agg(CAST(floor(x * 100 + 0.3137) AS BIGINT)::VARCHAR, ',' ORDER BY slot) AS vector FROM slots GROUP BY id"""


@query(hashed_vectors_sql("doc_id NOT IN (SELECT vec_id FROM embeddings)"))
def incremental_embedding(spark, sf):
    """Documents without a vector, embedded offline. Vectors are stored in single
    precision, so they are compared in hundredths, cut where no exact value lies."""
    d = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("heading"))
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    fresh = embed_new(d, [done], hashed_embedding(64), "hashed", 64)
    return fresh.select("id", "dim", hundredths("embedding").alias("vector"))


@query(
    """SELECT doc_id AS id, 64 AS dim FROM documents
    WHERE trim(text) <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 20"""
)
def trial_embedding(spark, sf):
    """A trial run: the first 20 documents without a vector."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("heading"))
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return embed_new(d, [done], hashed_embedding(64), "hashed", 64, limit=20).select("id", "dim")


@query(
    """SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'document_text is blank.' || CASE WHEN l.quality = 0 THEN ' ' ELSE '' END ELSE '' END
      || CASE WHEN l.quality = 0 THEN 'query_text is blank.' ELSE '' END AS reason
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def rejected_requests(spark, sf):
    """Requests without a text or a question, and why; the others have no reason.
    Toxic documents stand for blank texts, bad ones for missing questions."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    requests = d.join(labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("toxic") == 1, F.lit(" \n")).otherwise(F.col("text")).alias("document_text"),
        F.when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("source")).alias("query_text"),
    )
    accepted, rejected = split_requests(requests, "document_text", "query_text")
    return union_all([rejected.select("doc_id", "reason"), accepted.select("doc_id", F.lit("").alias("reason"))])


# Figure rows from parts, descriptions from the lines that order them.
FIGURES_SQL = """
figs AS (SELECT p_partkey AS id, p_brand AS doc, CAST(p_partkey AS VARCHAR) AS number, CASE WHEN p_size > 40 THEN p_name || ' ## Description' ELSE p_name END AS text FROM part),
descs AS (SELECT 'Brand#' || (l_suppkey % 25 + 1) AS doc, CAST(l_partkey AS VARCHAR) AS number, max_by(l_returnflag || l_orderkey, (l_orderkey, l_linenumber, l_extendedprice, l_quantity)) AS description FROM lineitem GROUP BY 1, 2),
joined AS (SELECT f.*, d.description FROM figs f LEFT JOIN descs d ON d.doc = f.doc AND d.number = f.number)"""


def _figure_match(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    figures = p.select(
        F.col("p_partkey").alias("id"), F.lit("figure").alias("node_type"), F.col("p_brand").alias("doc"), F.concat(F.lit("Figure "), "p_partkey", F.lit(": "), "p_name").alias("heading"),
        F.when(F.col("p_size") > 40, F.concat("p_name", F.lit(" ## Description"))).otherwise(F.col("p_name")).alias("text"),
    )
    raw = li.select(
        F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1).alias("doc"), F.concat(F.lit("figure-"), "l_partkey", F.lit(".png")).alias("image"),
        F.concat("l_returnflag", "l_orderkey").alias("description"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("at"),
    )
    return match_figures(figures, keyed_descriptions(raw, "at"))


@query(
    f"""WITH {FIGURES_SQL} SELECT CAST(id AS VARCHAR) AS id, CASE WHEN description IS NULL THEN 'unmatched' WHEN contains(text, '## Description') THEN 'described' ELSE 'update' END AS state, description FROM joined
    UNION ALL SELECT d.doc || '/' || d.number, 'unused', d.description FROM descs d WHERE NOT EXISTS (SELECT 1 FROM figs f WHERE f.doc = d.doc AND f.number = d.number)"""
)
def backfill_match(spark, sf):
    key = F.coalesce(F.col("id").cast("string"), F.concat_ws("/", "doc", "number"))
    return _figure_match(spark, sf).select(key.alias("id"), "state", "description")


# -- references ------------------------------------------------------------------

LINKS_SQL = r"""
links AS (SELECT page_id, pos, href, raw_text FROM (
  SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, trim(regexp_replace(unnest(t), '<[^>]*>', '', 'g')) AS raw_text FROM (
    SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h,
      regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS t FROM pages)) WHERE raw_text <> '')"""


@query(f"WITH {LINKS_SQL} SELECT page_id, pos, href, raw_text FROM links")
def link_scan(spark, sf):
    return page_links(table(spark, sf, "pages")).withColumn("pos", F.col("pos").cast("long"))


# Elements: every document is one, named by its first word, in the corpus of its source.
TARGETS_SQL = rf"""
targets AS (SELECT source AS corpus, 'pub-' || lang AS publishing_id, CAST(substr(source, 4) AS INTEGER) AS corpus_ord,
  lower(regexp_extract(text, '{WORDS}')) AS guid, doc_id AS pre FROM documents),
asked AS (SELECT page_id, pos, 'src' || (page_id % 20) AS corpus, lower(regexp_extract(href, '{WORDS}')) AS guid,
  CASE WHEN pos % 2 = 0 THEN 'pub-' || ['de', 'en', 'es', 'fr'][page_id % 4 + 1] END AS declared FROM links),
resolved AS (SELECT * FROM (
  SELECT a.page_id, a.pos, a.guid, a.declared, t.corpus AS t_corpus, t.pre AS t_pre, row_number() OVER (PARTITION BY a.page_id, a.pos ORDER BY
    CASE WHEN t.publishing_id = a.declared THEN 0 WHEN t.corpus = a.corpus THEN 1 ELSE 2 END, t.corpus_ord, t.pre) AS r
  FROM asked a LEFT JOIN targets t ON t.guid = a.guid) WHERE r = 1)"""


def _resolved(spark, sf):
    first = lambda c: F.lower(F.regexp_extract(c, WORDS, 0))
    targets = table(spark, sf, "documents").select(
        F.col("source").alias("corpus"), F.concat(F.lit("pub-"), "lang").alias("publishing_id"), F.substr("source", F.lit(4)).cast("int").alias("corpus_ord"),
        first("text").alias("node_id"), F.col("doc_id").alias("pre"),
    )
    tongue = F.element_at(F.array(*[F.lit(f"pub-{x}") for x in ("de", "en", "es", "fr")]), (F.col("page_id") % 4 + 1).cast("int"))
    asked = page_links(table(spark, sf, "pages")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("src"), F.col("page_id") % 20).alias("corpus"), first("href").alias("guid"),
        F.when(F.col("pos") % 2 == 0, tongue).alias("declared"),
    )
    return resolve_links(asked, targets)


@query(f"WITH {LINKS_SQL}, {TARGETS_SQL} SELECT page_id, pos, guid, t_corpus, t_pre FROM resolved")
def link_resolution(spark, sf):
    return _resolved(spark, sf).select("page_id", "pos", "guid", "t_corpus", "t_pre")


@query(f"WITH {LINKS_SQL}, {TARGETS_SQL} SELECT coalesce(declared, 'unknown') AS kind, count(*) AS total, count(t_pre) AS resolved FROM resolved GROUP BY 1")
def refs_by_kind(spark, sf):
    return quality.resolution_by_kind(_resolved(spark, sf).select(F.col("declared").alias("kind"), F.col("t_pre").alias("chunk_id")))


@query(f"WITH {LINKS_SQL}, {TARGETS_SQL} SELECT count(t_pre) AS resolved, count(*) - count(t_pre) AS unresolved FROM resolved")
def refs_resolution(spark, sf):
    return quality.resolution(_resolved(spark, sf).select(F.col("t_pre").alias("chunk_id")))


@query("WITH " + C + f", {LINKS_SQL.strip()}, {TARGETS_SQL.strip()} SELECT page_id, pos, t_pre AS chunk_id FROM resolved WHERE t_pre IS NOT NULL AND t_pre NOT IN (SELECT id FROM chunks WHERE embedding IS NOT NULL)")
def dangling_refs(spark, sf):
    refs = _resolved(spark, sf).select("page_id", "pos", F.col("t_pre").alias("chunk_id"))
    return quality.dangling(refs, chunks(spark, sf).where(F.col("embedding").isNotNull()))


@query(f"WITH {LINKS_SQL}, {TARGETS_SQL} SELECT DISTINCT guid FROM targets EXCEPT SELECT guid FROM asked")
def unused_targets(spark, sf):
    first = lambda c: F.lower(F.regexp_extract(c, WORDS, 0)).alias("guid")
    named = table(spark, sf, "documents").select(first("text")).distinct()
    return named.join(page_links(table(spark, sf, "pages")).select(first("href")), "guid", "left_anti")


# -- corpus counts -------------------------------------------------------------------

@query(with_ctes(C) + "SELECT doc, node_type, count(*) AS chunks FROM chunks GROUP BY doc, node_type")
def node_type_counts(spark, sf):
    return quality.node_type_counts(chunks(spark, sf))


@query(with_ctes(C) + "SELECT doc, count(DISTINCT clause_id) FILTER (node_type IN ('subclause', 'note')) AS clauses_total FROM chunks GROUP BY doc")
def clauses_per_doc(spark, sf):
    return quality.clauses_per_doc(chunks(spark, sf))


@query(with_ctes(C) + "SELECT doc, count(*) AS chunks FROM chunks GROUP BY doc")
def chunks_per_doc(spark, sf):
    return quality.doc_counts(chunks(spark, sf))


@query(
    """SELECT event_id, 'event_type_allowed' AS rule FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'error')
    UNION ALL SELECT event_id, 'value_explained' FROM events WHERE event_type = 'error' AND (props IS NULL OR props NOT LIKE '%9%')"""
)
def enum_rules(spark, sf):
    e = table(spark, sf, "events").withColumn("note", F.when(F.contains("props", F.lit("9")), F.col("props")))
    rules = [
        quality.one_of("event_type", "click", "view", "purchase", "error"),
        quality.Rule("value_explained", quality.explained_when("event_type", "error", "note").broken),
        quality.required("ts"),
    ]
    return quality.violations(e, "event_id", rules)


# -- conversations -------------------------------------------------------------------

def messages(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", "role", "text", (F.length("text") < 30).alias("is_error")
    )


@query(
    """SELECT conv_id AS conversation_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS role, md5(text) AS text_md5 FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 AND text <> ''"""
)
def history_last6(spark, sf):
    return conversations.recent_history(messages(spark, sf)).select("conversation_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
    SELECT a.conv_id AS conversation_id, a.i // 2 AS pair, md5(a.text) AS question_md5, md5(b.text) AS answer_md5 FROM m a JOIN m b ON b.conv_id = a.conv_id AND b.i = a.i + 1
    WHERE a.i % 2 = 0 AND a.role = 'user' AND b.role = 'assistant' AND length(b.text) >= 30"""
)
def answered_pairs(spark, sf):
    return conversations.answered_pairs(messages(spark, sf)).select("conversation_id", "pair", F.md5("question").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query(
    """SELECT conv_id AS conversation_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '…' ELSE t END AS title FROM (
      SELECT conv_id, min_by(text, turn) AS t FROM conversations GROUP BY conv_id)"""
)
def conversation_titles(spark, sf):
    return conversations.titles(messages(spark, sf))


@query("SELECT conv_id AS conversation_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id")
def last_activity(spark, sf):
    return conversations.last_activity(messages(spark, sf), "turn")


@query("SELECT role, CASE role WHEN 'assistant' THEN 'model' ELSE 'user' END AS model_role, count(*) AS n FROM conversations GROUP BY role")
def role_map(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("model_role", model_role("role"))


# -- workspace --------------------------------------------------------------------------

@query("SELECT event_id, value FROM events WHERE user_id = 7")
def owner_scope(spark, sf):
    return workspace.owned_by(table(spark, sf, "events"), 7).select("event_id", "value")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def list_projection(spark, sf):
    return workspace.listing(table(spark, sf, "documents"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt')")
def title_search(spark, sf):
    return table(spark, sf, "part").where(workspace.title_contains("p_name", "BOLT")).select("p_partkey", "p_name")


@query("SELECT event_id AS id, event_type AS clause_id, ts AS created_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id")
def feedback_newest(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("clause_id"), F.col("ts").alias("created_at"))
    return workspace.feedback(rows, "error")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate DESC, o_orderkey")
def recent_for_owner(spark, sf):
    rows = table(spark, sf, "orders").withColumn("user_id", F.col("o_custkey"))
    return workspace.newest_first(workspace.owned_by(rows, 11), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


def _folders(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("folder_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("ord"))


def _filed(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("folder_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", "done").otherwise("processing").alias("status"),
    )


@query(
    """SELECT n_nationkey AS folder_id, n_name AS name, count(c_custkey) AS documents FROM nation
    LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1, 2"""
)
def folder_counts(spark, sf):
    return workspace.folder_counts(_folders(spark, sf), _filed(spark, sf))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN n_name ELSE 'Unfiled' END AS "group", CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END AS unfiled
    FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment <> 'BUILDING'"""
)
def grouped_documents(spark, sf):
    return workspace.grouped_documents(_folders(spark, sf), _filed(spark, sf)).select("id", "group", "unfiled")


# -- review --------------------------------------------------------------------------------

DEAL_SQL = """
items AS (SELECT p_partkey AS key, p_brand AS corpus, CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size > 20 THEN 'a' ELSE 'b' END END AS pin FROM part),
sizes AS (SELECT corpus, count(*) AS n FROM items GROUP BY corpus),
short AS (SELECT s.corpus, g.grp, g.ord, greatest(n // 3 + CASE WHEN g.ord < n % 3 THEN 1 ELSE 0 END
    - (SELECT count(*) FROM items i WHERE i.corpus = s.corpus AND i.pin = g.grp), 0) AS short
  FROM sizes s, (VALUES ('a', 0), ('b', 1), ('c', 2)) g(grp, ord)),
slots AS (SELECT corpus, grp, row_number() OVER (PARTITION BY corpus ORDER BY level DESC, ord) AS r FROM (SELECT corpus, grp, ord, unnest(range(1, short + 1)) AS level FROM short)),
free AS (SELECT key, corpus, row_number() OVER (PARTITION BY corpus ORDER BY key) AS r FROM items WHERE pin IS NULL),
dealt AS (SELECT f.key, f.corpus, s.grp, false AS pinned FROM free f JOIN slots s ON s.corpus = f.corpus AND s.r = f.r
  UNION ALL SELECT key, corpus, pin, true FROM items WHERE pin IS NOT NULL)"""


BRANDS = tuple(f"Brand#{n}" for n in range(1, 26))


def _dealt(spark, sf):
    p = table(spark, sf, "part")
    items = p.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("corpus"))
    pinned = p.where("p_type = 'PROMO'").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 20, "a").otherwise("b").alias("grp"))
    return review.deal(items, pinned)


@query(f"WITH {DEAL_SQL} SELECT key, corpus, grp, pinned FROM dealt")
def balanced_deal(spark, sf):
    return _dealt(spark, sf)


@query(
    f"""WITH {DEAL_SQL}, v AS (SELECT l_partkey AS key, CASE WHEN max(l_discount) > 0.08 THEN 'correct' ELSE 'incorrect' END AS verdict FROM lineitem GROUP BY 1 HAVING count(*) > 30)
    SELECT grp, count(*) AS total, {", ".join(f"count(*) FILTER (corpus = '{b}') AS \"{b}\"" for b in BRANDS)}, count(verdict) AS reviewed, count(*) FILTER (verdict = 'correct') AS correct,
      count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (pinned) AS pinned,
      count(*) FILTER (key % 3 = 0 AND CASE WHEN key % 2 = 0 THEN 'a' ELSE 'b' END <> grp) AS moved FROM dealt LEFT JOIN v USING (key) GROUP BY grp"""
)
def review_progress(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.max("l_discount").alias("d"))
    verdicts = lines.where("n > 30").select("key", F.when(F.col("d") > 0.08, "correct").otherwise("incorrect").alias("verdict"))
    before = table(spark, sf, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("grp"))
    return review.progress(_dealt(spark, sf), verdicts, list(BRANDS), before)


# -- evaluation ------------------------------------------------------------------------------

EVAL_SQL = """
expected AS (SELECT query_id AS qid, ['C' || (query_id % 50), 'C' || ((query_id + 1) % 50)] AS clauses, string_split(query_text, ' ') AS phrases FROM queries),
results AS (SELECT query_id AS qid, list(clause_id) FILTER (clause_id IS NOT NULL) AS chips, string_agg(text, ' ' ORDER BY rerank_rank) AS answer, max(rerank_score) < 0.9 AS abstained
  FROM reranked WHERE rerank_rank <= 8 GROUP BY query_id),
judged AS (SELECT e.qid, r.abstained, list_has_any(e.clauses, coalesce(r.chips, [])) AS clause_hit,
    list_filter(e.phrases, lambda p: NOT contains(lower(r.answer), lower(p))) AS missing FROM expected e JOIN results r ON r.qid = e.qid)"""


def _judged(spark, sf):
    q = F.col("query_id")
    expected = queries(spark, sf).select(
        q.alias("qid"), F.array(F.concat(F.lit("C"), q % 50), F.concat(F.lit("C"), (q + 1) % 50)).alias("clauses"), F.split("query_text", " ").alias("phrases")
    )
    hits = retrieved(spark, sf)
    ordered = F.array_sort(F.collect_list(F.struct("rerank_rank", "text")))
    results = hits.groupBy(q.alias("qid")).agg(
        F.collect_list("clause_id").alias("chips"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("answer"), (F.max("rerank_score") < 0.9).alias("abstained")
    )
    return evaluation.judge(expected, results)


@query(with_ctes(*RETRIEVED, EVAL_SQL) + "SELECT qid, abstained, clause_hit, array_to_string(missing, '|') AS text_missing FROM judged")
def evaluation_join(spark, sf):
    return _judged(spark, sf).select("qid", "abstained", "clause_hit", F.array_join("text_missing", "|").alias("text_missing"))


@query(
    with_ctes(*RETRIEVED, EVAL_SQL)
    + """SELECT count(*) AS questions, count(*) FILTER (clause_hit) AS clause_hits, count(clause_hit) AS clause_checks, sum(len(missing))::BIGINT AS phrases_missing,
    count(*) FILTER (abstained) AS abstained FROM judged"""
)
def evaluation_summary(spark, sf):
    return evaluation.summarise(_judged(spark, sf))
