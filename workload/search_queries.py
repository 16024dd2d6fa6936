"""Search: filters, ranks, fusion, rerank, context, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions.porter2 import ENGLISH_STOP_WORDS
from corpuskit.functions.text import context_block, requirement_block
from corpuskit.operators import dictionary, filters, inverted, quantised
from corpuskit.operators.dense import approximate_top_k, dense_top_k, hyperplanes, with_cells
from corpuskit.operators.fusion import fuse
from corpuskit.operators.glossary import definitions_for, glossary_terms, quoted_definitions, quoted_openings, terms_in_questions
from corpuskit.operators.lexical import lexical_top_k, postings, term_statistics, with_tokens
from corpuskit.operators.ranking import union_all
from corpuskit.plans.answers import abstain_gate, audit_answers, build_context, citations, one_per_clause
from corpuskit.plans.compliance import analyse_documents, findings, status_counts
from corpuskit.plans.hybrid import hybrid_hits, hybrid_search, retrieve
from workload.registry import query
from workload.tables import (
    LANGUAGES,
    CHUNKS_SQL, DENSE_SQL, LEXICAL_SQL, QUERIES_SQL, WORDS, chunks, fused_sql, queries, table, text_index, with_ctes,
)

C, Q = CHUNKS_SQL, QUERIES_SQL
PAYLOAD = ["clause_id", "doc", "node_type", "heading", "text", "jurisdictions", "defined_terms"]
SEARCH = (C, Q, DENSE_SQL, LEXICAL_SQL)

RERANK_SQL = rf"""
pairs AS (
  SELECT f.query_id, f.id, f.fused_score, f.rank, c.clause_id, c.doc, c.node_type, c.heading, c.text, c.jurisdictions, c.defined_terms,
    list_distinct(regexp_extract_all(lower(q.query_text), '{WORDS}')) AS asked, list_distinct(regexp_extract_all(lower(c.text), '{WORDS}')) AS has
  FROM fused f JOIN chunks c ON c.id = f.id JOIN queries q ON q.query_id = f.query_id),
scored AS (
  SELECT *, CASE WHEN len(asked) > 0 THEN round(len(list_intersect(asked, has))::DOUBLE / len(asked), 6) ELSE 0 END AS rerank_score FROM pairs),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM scored)"""

RETRIEVED = (*SEARCH, fused_sql(30), RERANK_SQL)

GLOSSARY_SQL = r"""
glossary AS (
  SELECT term, definition, gid FROM (
    SELECT trim(heading) AS term, coalesce(text, '') AS definition, id AS gid,
      row_number() OVER (PARTITION BY trim(heading) ORDER BY id) AS r
    FROM chunks WHERE node_type = 'glossary' AND heading IS NOT NULL) WHERE r = 1)"""

# A second glossary with single-word terms, the first word of every item.
WORD_GLOSSARY_SQL = rf"""
words_glossary AS (
  SELECT term, text AS definition, item_id AS gid FROM (
    SELECT *, row_number() OVER (PARTITION BY term ORDER BY item_id) AS r FROM (
      SELECT item_id, text, unnest(list_distinct(regexp_extract_all(lower(text), '{WORDS}'))) AS term FROM benchmark))
  WHERE r = 1)"""

QUESTION_TERMS_SQL = r"""
near_terms AS MATERIALIZED (
  SELECT q.query_id, q.query_text, g.term, g.gid FROM queries q JOIN words_glossary g
    ON length(g.term) > 1 AND contains(lower(q.query_text), lower(g.term))),
question_terms AS MATERIALIZED (
  SELECT query_id, term, gid FROM near_terms WHERE
    CASE WHEN length(term) <= 3 OR substr(term, 2) <> lower(substr(term, 2))
      THEN regexp_matches(query_text, '(^|[^\p{L}\p{N}_])' || regexp_escape(term) || '($|[^\p{L}\p{N}_])')
      ELSE regexp_matches(query_text, '(?i)(^|[^\p{L}\p{N}_])' || regexp_escape(term) || '($|[^\p{L}\p{N}_])') END)"""

DEFINITIONS_SQL = r"""
wanted AS (
  SELECT query_id, term, 0 AS a, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, gid, term) AS b, 0 AS c FROM question_terms
  UNION ALL
  SELECT query_id, term, 1, rank, pos FROM (
    SELECT query_id, rerank_rank AS rank, unnest(defined_terms) AS term, unnest(range(len(defined_terms))) AS pos
    FROM reranked WHERE rerank_rank <= 8) WHERE term IN (SELECT term FROM words_glossary)),
definitions AS (
  SELECT query_id, term, ord FROM (
    SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min((a, b, c)), term) AS ord FROM wanted GROUP BY query_id, term)
  WHERE ord <= 15)"""


def word_glossary(spark, sf):
    items = table(spark, sf, "benchmark")
    words = items.select(
        "item_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))).alias("term")
    )
    first = words.groupBy("term").agg(F.min("item_id").alias("gid"))
    return first.join(items.select(F.col("item_id").alias("gid"), F.col("text").alias("definition")), "gid").select("term", "definition", "gid")


def questions(spark, sf):
    return queries(spark, sf).select("query_id", F.col("query_text").alias("question"))


@query(with_ctes(C) + "SELECT id, heading FROM chunks WHERE node_type = 'table'")
def node_type_scan(spark, sf):
    return chunks(spark, sf).where(F.col("node_type") == "table").select("id", "heading")


@query(with_ctes(C, GLOSSARY_SQL) + "SELECT term, gid, md5(definition) AS definition_md5 FROM glossary")
def glossary_scan(spark, sf):
    return glossary_terms(chunks(spark, sf)).select("term", "gid", F.md5("definition").alias("definition_md5"))


@query(with_ctes(C) + "SELECT id, len(embedding)::BIGINT AS dim FROM chunks")
def preferred_source(spark, sf):
    return chunks(spark, sf).select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dim"))


@query(
    with_ctes(C, Q)
    + """SELECT j.jurisdiction, count(*) AS visible FROM (SELECT DISTINCT jurisdiction FROM queries) j
    JOIN chunks c ON j.jurisdiction IS NULL OR c.jurisdictions IS NULL OR list_contains(c.jurisdictions, j.jurisdiction)
    GROUP BY j.jurisdiction"""
)
def jurisdiction_filter(spark, sf):
    # What is asked and what rows name are few distinct values: counts are joined, not rows.
    asked = queries(spark, sf).select(filters.checked_jurisdiction("jurisdiction", LANGUAGES).alias("jurisdiction")).distinct()
    named = chunks(spark, sf).groupBy("jurisdictions").agg(F.count(F.lit(1)).alias("n"))
    open_to = F.coalesce("jurisdictions", F.array(F.lit("")))  # '' stands for every jurisdiction
    listed = named.select("n", F.explode(F.array_distinct(open_to)).alias("name"))
    all_asked = asked.select("jurisdiction", F.explode(F.array(F.lit(""), F.coalesce("jurisdiction", F.lit("*")))).alias("name"))
    total = union_all([listed, named.agg(F.sum(F.when(F.col("jurisdictions").isNotNull(), F.col("n"))).alias("n")).withColumn("name", F.lit("*"))])
    return all_asked.join(total, "name").groupBy("jurisdiction").agg(F.sum("n").alias("visible"))


@query(with_ctes(C) + "SELECT id FROM chunks WHERE node_type <> 'glossary' AND embedding IS NOT NULL")
def searchable_embedded(spark, sf):
    return filters.embedded(filters.searchable(chunks(spark, sf))).select("id")


@query(with_ctes(C) + "SELECT id FROM chunks WHERE jurisdictions IS NULL OR list_has_any(jurisdictions, ['DE', 'FR'])")
def applicability_prefilter(spark, sf):
    return chunks(spark, sf).where(filters.applies_to("jurisdictions", "DE", "FR")).select("id")


@query(with_ctes(C, Q, LEXICAL_SQL) + "SELECT id, term, pos + 1 AS pos FROM postings")
def fulltext_document(spark, sf):
    return postings(filters.searchable(chunks(spark, sf))).select("id", "term", F.col("pos").cast("long").alias("pos"))


# The same rules as in Spark, in the other dialect.
DUCKDB = dictionary.Dialect("regexp_matches({x}, '{p}')", "ends_with({x}, '{s}')", r"regexp_replace({x}, '([aeiouy])y', '\1Y', 'g')")
STOPS_SQL = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
STEMS_SQL = f"""
stems AS MATERIALIZED ({dictionary.stems_sql(f"""SELECT term FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(heading, '') || ' ' || text), '{WORDS}')) AS term FROM chunks
    UNION SELECT DISTINCT unnest(regexp_extract_all(lower(query_text), '{WORDS}')) FROM queries) WHERE term NOT IN ({STOPS_SQL})""", DUCKDB)})"""
ENGLISH_SQL = LEXICAL_SQL.replace(
    f"FROM (SELECT DISTINCT query_id, jurisdiction, unnest(regexp_extract_all(lower(query_text), '{WORDS}')) AS term FROM queries)",
    f"""FROM (SELECT DISTINCT query_id, jurisdiction, stem AS term FROM (
      SELECT query_id, jurisdiction, unnest(regexp_extract_all(lower(query_text), '{WORDS}')) AS term FROM queries) JOIN stems USING (term))""",
).replace(
    "SELECT id, jurisdictions, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM tokens)",
    """SELECT id, jurisdictions, stem AS term, pos FROM (
    SELECT id, jurisdictions, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM tokens) JOIN stems USING (term))""",
)


@query(with_ctes(C, Q, STEMS_SQL, ENGLISH_SQL) + "SELECT id, term, pos + 1 AS pos FROM postings")
def fulltext_english(spark, sf):
    """Stems and their places: every distinct word is stemmed once."""
    tokens = with_tokens(filters.searchable(chunks(spark, sf)))
    stemmed = dictionary.stemmed(postings(tokens), spark.read.parquet(dictionary.build(dictionary.terms_of(tokens))))
    return stemmed.select("id", "term", F.col("pos").cast("long").alias("pos"))


@query(with_ctes(C, Q, STEMS_SQL, ENGLISH_SQL) + "SELECT query_id, id, score, rank FROM lexical")
def english_topk(spark, sf):
    """The stored index of plain words, asked for all words with the stems of a query's."""
    index = text_index(spark, sf)
    words = inverted.words(index, spark).where(~F.col("term").isin(*ENGLISH_STOP_WORDS))
    asked = inverted.english_queries(index, queries(spark, sf), spark.read.parquet(dictionary.build(words)))
    return inverted.top_k(index, asked).withColumn("rank", F.col("rank").cast("long"))


@query(with_ctes(C, Q, LEXICAL_SQL) + "SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM postings GROUP BY term")
def term_frequencies(spark, sf):
    return term_statistics(filters.searchable(chunks(spark, sf)))


@query(with_ctes(C, Q, LEXICAL_SQL) + "SELECT query_id, id FROM matched")
def fulltext_match_all(spark, sf):
    return inverted.matches(text_index(spark, sf), queries(spark, sf)).select("query_id", "id")


@query(with_ctes(C, Q, LEXICAL_SQL) + "SELECT query_id, id, score FROM density")
def cover_density_rank(spark, sf):
    return inverted.matches(text_index(spark, sf), queries(spark, sf))


@query(with_ctes(C, Q, DENSE_SQL) + "SELECT query_id, id, distance, rank FROM dense")
def dense_topk(spark, sf):
    return dense_top_k(chunks(spark, sf), queries(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(with_ctes(C, Q, LEXICAL_SQL) + "SELECT query_id, id, score, rank FROM lexical")
def lexical_topk(spark, sf):
    return inverted.top_k(text_index(spark, sf), queries(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@query(
    with_ctes(*SEARCH)
    + """SELECT query_id, id, rank, 'dense' AS method FROM dense UNION ALL SELECT query_id, id, rank, 'lexical' FROM lexical"""
)
def rank_union(spark, sf):
    c, q = chunks(spark, sf), queries(spark, sf)
    sides = {"dense": dense_top_k(c, q), "lexical": lexical_top_k(c, q)}
    return union_all([d.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.lit(n).alias("method")) for n, d in sides.items()])


@query(with_ctes(*SEARCH, fused_sql(100)) + "SELECT query_id, id, fused_score FROM fused")
def rrf_fusion(spark, sf):
    c, q = chunks(spark, sf), queries(spark, sf)
    return fuse(dense_top_k(c, q), lexical_top_k(c, q), top=100).select("query_id", "id", "fused_score")


@query(
    with_ctes(*SEARCH, fused_sql(10))
    + """SELECT f.query_id, f.id, f.fused_score, f.rank, c.clause_id, c.doc, c.node_type, c.heading
    FROM fused f JOIN chunks c ON c.id = f.id"""
)
def hybrid_search_top10(spark, sf):
    hits = hybrid_search(chunks(spark, sf), queries(spark, sf), payload=["clause_id", "doc", "node_type", "heading"], jurisdictions=LANGUAGES, index=text_index(spark, sf))
    return hits.withColumn("rank", F.col("rank").cast("long"))


def retrieved(spark, sf, top_n=8):
    return retrieve(chunks(spark, sf), queries(spark, sf), top_n, payload=PAYLOAD, jurisdictions=LANGUAGES, index=text_index(spark, sf))


@query(
    with_ctes(*RETRIEVED)
    + "SELECT query_id, id, fused_score, rerank_score, rerank_rank, doc, md5(text) AS text_md5 FROM reranked WHERE rerank_rank <= 8"
)
def rerank_topn(spark, sf):
    return retrieved(spark, sf).select(
        "query_id", "id", "fused_score", "rerank_score", F.col("rerank_rank").cast("long").alias("rerank_rank"), "doc", F.md5("text").alias("text_md5")
    )


CITABLE = """NOT (node_type = 'part' AND doc IN ('src1', 'src2')) AND trim(text, chr(10) || ' ') <> ''
  AND trim(text, chr(10) || ' ') <> trim(CASE WHEN starts_with(heading, coalesce(clause_id, ''))
    THEN substr(heading, length(coalesce(clause_id, '')) + 1) ELSE heading END, chr(10) || ' ')"""


@query(with_ctes(C) + f"SELECT id FROM chunks WHERE {CITABLE}")
def citable_chunks(spark, sf):
    return chunks(spark, sf).where(filters.citable(("src1", "src2"))).select("id")


@query(
    with_ctes(*RETRIEVED)
    + """SELECT query_id, id, clause_id, doc FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, clause_id, doc ORDER BY rerank_rank) AS r
      FROM reranked WHERE rerank_rank <= 8 AND clause_id IS NOT NULL) WHERE r = 1"""
)
def one_hit_per_clause(spark, sf):
    return one_per_clause(retrieved(spark, sf), "rerank_rank").select("query_id", "id", "clause_id", "doc")


@query(
    with_ctes(*RETRIEVED)
    + f"""SELECT query_id, id, clause_id, doc FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, clause_id, doc ORDER BY rerank_rank) AS r
      FROM reranked WHERE rerank_rank <= 8 AND clause_id IS NOT NULL AND {CITABLE.replace("('src1', 'src2')", "('ABCB Housing Provisions')")}) WHERE r = 1"""
)
def hit_citations(spark, sf):
    return citations(retrieved(spark, sf), "rerank_rank").select("query_id", "id", "clause_id", "doc")


@query(
    with_ctes(*RETRIEVED)
    + """SELECT q.query_id, coalesce(t.top >= 0.9, false) AS strong_match, NOT coalesce(t.top >= 0.9, false) AS abstained
    FROM queries q LEFT JOIN (SELECT query_id, max(rerank_score) AS top FROM reranked WHERE rerank_rank <= 8 GROUP BY query_id) t
      ON t.query_id = q.query_id"""
)
def abstain_gate_by_score(spark, sf):
    asked = questions(spark, sf).withColumn("attachment_text", F.lit(None).cast("string"))
    return abstain_gate(asked, retrieved(spark, sf), floor=0.9).select("query_id", "strong_match", "abstained")


@query(with_ctes(C, Q, WORD_GLOSSARY_SQL, QUESTION_TERMS_SQL) + "SELECT query_id, term FROM question_terms")
def terms_in_question(spark, sf):
    return terms_in_questions(questions(spark, sf), word_glossary(spark, sf)).select("query_id", "term")


@query(
    with_ctes(*RETRIEVED, WORD_GLOSSARY_SQL, QUESTION_TERMS_SQL, DEFINITIONS_SQL)
    + """SELECT d.query_id, d.term, d.ord, md5(g.definition) AS definition_md5 FROM definitions d JOIN words_glossary g ON g.term = d.term"""
)
def definitions_for_hits(spark, sf):
    hits = retrieved(spark, sf).drop("rank").withColumnRenamed("rerank_rank", "rank")
    found = definitions_for(hits, questions(spark, sf), word_glossary(spark, sf))
    return found.select("query_id", "term", F.col("ord").cast("long").alias("ord"), F.md5("definition").alias("definition_md5"))


def _shaped(df):
    """Chunks with classes, zones, a note and standards by their ids, each for some."""
    key = F.col("id")
    standard = F.struct(F.when(key % 2 == 1, F.concat(F.lit(" AS "), key)).alias("standard"))
    columns = {
        "building_classes": F.when(key % 5 == 0, F.array((key % 9).cast("string"), F.lit("9c"))),
        "climate_zones": F.when(key % 7 == 0, F.array((key % 8).cast("int"), F.lit(12))),
        "applicability_note": F.when(key % 11 == 0, F.lit("Not in TAS")),
        "standard_refs": F.when(key % 3 == 0, F.array(standard, F.struct(F.lit("AS 1").alias("standard")))),
    }
    return df.withColumns(columns)


APPLIES_SQL = """concat_ws('; ', CASE WHEN id % 5 = 0 THEN 'building classes: ' || (id % 9) || ', 9c' END,
  CASE WHEN jurisdictions IS NOT NULL THEN 'jurisdictions: ' || array_to_string(jurisdictions, ', ') END,
  CASE WHEN id % 7 = 0 THEN 'climate zones: ' || (id % 8) || ', 12' END, CASE WHEN id % 11 = 0 THEN 'Not in TAS' END)"""
BLOCK_SQL = f"""coalesce(clause_id, 'unknown clause') || ' {{dash}} ' || doc || CASE WHEN heading <> '' THEN ': ' || heading ELSE '' END || ']' || chr(10) || text
  || CASE WHEN {APPLIES_SQL} <> '' THEN chr(10) || 'Applicability: ' || {APPLIES_SQL} ELSE '' END"""
HANDOFF_SQL = "CASE WHEN id % 3 = 0 THEN chr(10) || 'Australian Standard hand-off: ' || CASE WHEN id % 2 = 1 THEN 'AS ' || id ELSE '?' END || ', AS 1' ELSE '' END"


@query(
    with_ctes(C)
    + f"""SELECT id, md5('[' || {BLOCK_SQL.format(dash='—')} || {HANDOFF_SQL}) AS context_md5, md5('[clause_id: ' || {BLOCK_SQL.format(dash='--')}) AS requirement_md5 FROM chunks"""
)
def context_blocks(spark, sf):
    return _shaped(chunks(spark, sf)).select("id", F.md5(context_block()).alias("context_md5"), F.md5(requirement_block()).alias("requirement_md5"))


@query(
    with_ctes(*RETRIEVED, WORD_GLOSSARY_SQL, QUESTION_TERMS_SQL, DEFINITIONS_SQL)
    + f""", best AS (SELECT query_id, max(rerank_score) AS top FROM reranked WHERE rerank_rank <= 8 GROUP BY query_id),
    blocks AS (SELECT query_id, string_agg('[' || {BLOCK_SQL.format(dash='—')} || {HANDOFF_SQL}, chr(10) || chr(10) ORDER BY rerank_rank) AS context
      FROM reranked WHERE rerank_rank <= 8 GROUP BY query_id),
    lines AS (SELECT d.query_id, string_agg(d.term || ': ' || g.definition, chr(10) ORDER BY d.ord) AS definitions
      FROM definitions d JOIN words_glossary g ON g.term = d.term GROUP BY d.query_id)
    SELECT q.query_id, md5('CONTEXT:' || chr(10) || coalesce(b.context, '(none retrieved)') || chr(10) || chr(10)
      || CASE WHEN b.context IS NOT NULL AND l.definitions IS NOT NULL THEN 'DEFINITIONS:' || chr(10) || l.definitions || chr(10) || chr(10) ELSE '' END
      || CASE WHEN q.query_id % 3 = 0 THEN 'ATTACHED DOCUMENT (' || CASE WHEN q.query_id % 2 = 0 THEN 'plan.txt' ELSE 'the attached document' END || '):' || chr(10) || 'Plan ' || q.query_id || chr(10) || chr(10) ELSE '' END
      || 'QUESTION: ' || q.query_text) AS prompt_md5
    FROM queries q LEFT JOIN best t ON t.query_id = q.query_id
    LEFT JOIN blocks b ON b.query_id = q.query_id AND t.top >= 0.9 LEFT JOIN lines l ON l.query_id = q.query_id WHERE t.top >= 0.9 OR q.query_id % 3 = 0"""
)
def answer_context(spark, sf):
    """Every third question brings an attachment, and so is answered without hits too;
    the floor is set where some questions fall below it."""
    key = F.col("query_id")
    asked = questions(spark, sf).withColumns({
        "attachment_name": F.when(key % 2 == 0, F.lit("plan.txt")),
        "attachment_text": F.when(key % 3 == 0, F.concat(F.lit(" Plan "), key, F.lit("\n"))).otherwise(" "),
    })
    prompts = build_context(asked, _shaped(retrieved(spark, sf)), word_glossary(spark, sf), floor=0.9)
    return prompts.select("query_id", F.md5("prompt").alias("prompt_md5"))


# Answers: every assistant turn, quoting or not what the glossary says.
SQUASH = r"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


@query(
    f"""WITH answers AS (SELECT doc_id AS query_id, text AS answer FROM documents),
    probes AS (SELECT item_id, substr({SQUASH.format(c="text")}, 1, 40) AS probe FROM benchmark)
    SELECT a.query_id, p.item_id FROM answers a JOIN probes p ON p.probe <> '' AND contains({SQUASH.format(c="a.answer")}, p.probe)"""
)
def quoted_benchmark_items(spark, sf):
    """Which documents quote the opening of a benchmark item."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))
    return quoted_openings(docs, table(spark, sf, "benchmark").select("item_id", "text"))


ANSWER_SQL = """
answers AS (
  SELECT query_id, CASE query_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  [[NO_ANSWER]] ' || query_text
    WHEN 2 THEN query_text || ' [[NO_ANSWER]]' ELSE 'As defined: ' || b.text END AS answer
  FROM queries JOIN benchmark b ON b.item_id = query_id)"""


def answers(spark, sf):
    asked = queries(spark, sf).join(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    case = F.col("query_id") % 4
    text = (
        F.when(case == 0, "")
        .when(case == 1, F.concat(F.lit("  [[NO_ANSWER]] "), "query_text"))
        .when(case == 2, F.concat("query_text", F.lit(" [[NO_ANSWER]]")))
        .otherwise(F.concat(F.lit("As defined: "), "text"))
    )
    return asked.select("query_id", text.alias("answer"))


@query(
    with_ctes(C, Q, ANSWER_SQL)
    + """SELECT query_id, answer = '' OR starts_with(ltrim(answer), '[[NO_ANSWER]]') AS abstained,
      CASE WHEN answer = '' THEN 'No source found.'
        WHEN starts_with(ltrim(answer), '[[NO_ANSWER]]') THEN coalesce(nullif(trim(substr(ltrim(answer), 14)), ''), 'No source found.')
        ELSE answer END AS answer FROM answers"""
)
def answer_marker(spark, sf):
    return answers(spark, sf).select("query_id", filters.parse_answer("answer").alias("p")).select("query_id", "p.*")


@query(
    with_ctes(*RETRIEVED, WORD_GLOSSARY_SQL, QUESTION_TERMS_SQL, DEFINITIONS_SQL, ANSWER_SQL)
    + f""", given AS (SELECT * FROM answers WHERE answer <> '' AND NOT starts_with(ltrim(answer), '[[NO_ANSWER]]')),
    cited AS (SELECT query_id, 'chunk' AS source, rerank_rank AS ord, clause_id, doc FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, clause_id, doc ORDER BY rerank_rank) AS r
      FROM reranked WHERE rerank_rank <= 8 AND clause_id IS NOT NULL AND {CITABLE.replace("('src1', 'src2')", "('ABCB Housing Provisions')")})
      WHERE r = 1 AND query_id IN (SELECT query_id FROM given)),
    quoted AS (SELECT d.query_id, 'definition' AS source, d.ord, d.term AS clause_id, 'NCC Schedule 1 -- Definitions' AS doc
      FROM definitions d JOIN words_glossary g ON g.term = d.term JOIN given a ON a.query_id = d.query_id
      WHERE contains({SQUASH.format(c="a.answer")}, substr({SQUASH.format(c="g.definition")}, 1, 40)))
    SELECT * FROM cited UNION ALL SELECT * FROM quoted"""
)
def answer_audit(spark, sf):
    hits = retrieved(spark, sf).drop("rank").withColumnRenamed("rerank_rank", "rank")
    definitions = definitions_for(hits, questions(spark, sf), word_glossary(spark, sf))
    cites = audit_answers(answers(spark, sf), hits, definitions)[1]
    return cites.select("query_id", "source", F.col("ord").cast("long").alias("ord"), "clause_id", "doc")


@query(
    with_ctes(C, Q, WORD_GLOSSARY_SQL, ANSWER_SQL)
    + f"""SELECT a.query_id, g.term FROM answers a JOIN words_glossary g ON g.gid = a.query_id
    WHERE contains({SQUASH.format(c="a.answer")}, substr({SQUASH.format(c="g.definition")}, 1, 40))"""
)
def quoted_definitions_of_answers(spark, sf):
    own = word_glossary(spark, sf).select(F.col("gid").alias("query_id"), "term", "definition", F.lit(1).alias("ord"))
    return quoted_definitions(answers(spark, sf), own).select("query_id", F.col("clause_id").alias("term"))


FINDINGS_SQL = rf"""
required AS (
  SELECT query_id, id, clause_id, doc, heading, has FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, clause_id, doc ORDER BY rerank_rank) AS r
    FROM reranked WHERE rerank_rank <= 10 AND clause_id IS NOT NULL) WHERE r = 1)"""


@query(
    with_ctes(*RETRIEVED, FINDINGS_SQL)
    + rf"""SELECT r.query_id, r.clause_id, r.doc, r.heading,
      CASE WHEN len(list_intersect(r.has, regexp_extract_all(lower(b.text), '{WORDS}'))) > 0 THEN 'needs_review' ELSE 'missing' END AS status,
      len(list_intersect(r.has, list_distinct(regexp_extract_all(lower(b.text), '{WORDS}')))) || ' shared words' AS explanation
    FROM required r JOIN benchmark b ON b.item_id = r.query_id"""
)
def compliance_findings(spark, sf):
    documents = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("document_text"))
    requests = queries(spark, sf).join(documents, "query_id")
    found = analyse_documents(chunks(spark, sf), requests, word_glossary(spark, sf), payload=PAYLOAD, jurisdictions=LANGUAGES, index=text_index(spark, sf))[0]
    return found.select("query_id", "clause_id", "doc", "heading", "status", "explanation")


@query(
    with_ctes(C)
    + """SELECT c.id AS query_id, c.clause_id, c.doc, coalesce(s.status, 'needs_review') AS status,
      coalesce(s.explanation, 'The analysis engine did not return a classification for this clause -- review it manually.') AS explanation
    FROM chunks c LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'addressed' ELSE 'missing' END AS status,
      'quality ' || quality AS explanation FROM labels) s ON s.doc_id = c.id AND c.clause_id IS NOT NULL"""
)
def findings_with_default(spark, sf):
    required = chunks(spark, sf).select(F.col("id").alias("query_id"), "clause_id", "doc", "heading")
    status = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "addressed").otherwise("missing")
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("query_id"), status.alias("status"), F.concat(F.lit("quality "), "quality").alias("explanation"), F.lit(None).cast("string").alias("evidence")
    )
    classified = labels.join(required.select("query_id", "clause_id"), "query_id")
    return findings(required, classified).select("query_id", "clause_id", "doc", "status", "explanation")


@query(
    """SELECT d.source AS doc, count(*) FILTER (toxic = 0 AND quality = 1) AS addressed, count(*) FILTER (toxic = 0 AND quality = 0) AS missing,
      count(*) FILTER (toxic = 1) AS contradicted, count(*) FILTER (l.doc_id IS NULL) AS needs_review
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source"""
)
def status_counts_zero_filled(spark, sf):
    status = (
        F.when(F.col("quality").isNull(), "needs_review")
        .when(F.col("toxic") == 1, "contradicted")
        .when(F.col("quality") == 1, "addressed")
        .otherwise("missing")
    )
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(F.col("source").alias("doc"), status.alias("status"))
    return status_counts(rows, ["doc"])


PLANES = hyperplanes(64, 6)
FLIPS = 3
CELL_SQL = " + ".join(
    f"CASE WHEN list_inner_product({{v}}::DOUBLE[], {plane}::DOUBLE[]) >= 0 THEN {1 << bit} ELSE 0 END" for bit, plane in enumerate(PLANES)
)


@query(
    with_ctes(C, Q, DENSE_SQL)
    + f""", cells AS (SELECT id, node_type, jurisdictions, embedding, {CELL_SQL.format(v="embedding")} AS cell FROM chunks WHERE embedding IS NOT NULL AND node_type <> 'glossary'),
    homes AS (SELECT query_id, jurisdiction, qvec, {CELL_SQL.format(v="qvec")} AS home FROM queries WHERE qvec IS NOT NULL),
    near AS (SELECT query_id, id FROM (SELECT q.query_id, c.id, row_number() OVER (PARTITION BY q.query_id ORDER BY
        round(1 - list_cosine_similarity(c.embedding::DOUBLE[], q.qvec::DOUBLE[]), 6), c.id) AS r
      FROM homes q JOIN cells c ON bit_count(xor(q.home, c.cell)) <= {FLIPS}
        AND (q.jurisdiction IS NULL OR c.jurisdictions IS NULL OR list_contains(c.jurisdictions, q.jurisdiction))) WHERE r <= 10)
    SELECT d.query_id, count(*) AS wanted, count(n.id) AS found FROM dense d LEFT JOIN near n ON n.query_id = d.query_id AND n.id = d.id WHERE d.rank <= 10 GROUP BY d.query_id"""
)
def approximate_dense_recall(spark, sf):
    """Share of the exact top 10 that the bucketed form finds, per query. The given
    vectors point anywhere, so cells alone cannot find nine in ten in a quarter of
    the rows: 42 of 64 cells are read."""
    c = chunks(spark, sf)
    q = queries(spark, sf).where(F.col("qvec").isNotNull())
    exact = dense_top_k(c, q, 10).select("query_id", "id")
    near = approximate_top_k(with_cells(c, PLANES), q, PLANES, 10, flips=FLIPS).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found")
    )


@query(with_ctes(C, Q, DENSE_SQL) + "SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS nine_in_ten FROM dense WHERE rank <= 10")
def quantised_dense_recall(spark, sf):
    """Whether a search by codes of a sixteenth of the bytes finds nine in ten or more
    of all exact top 10s."""
    c, q = chunks(spark, sf), queries(spark, sf)
    exact = dense_top_k(c, q, 10).select("query_id", "id")
    near = quantised.top_k(quantised.build(c), c, q, 10).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") * 10 >= F.count(F.lit(1)) * 9).alias("nine_in_ten")
    )


def flagship(spark, sf):
    return hybrid_hits(chunks(spark, sf), queries(spark, sf), jurisdictions=LANGUAGES, index=text_index(spark, sf))
