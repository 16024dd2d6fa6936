"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import captions, citations, markers, text, vectors
from corpuskit.operators.references import cited_in_prose, cited_standards, unique_numbers
from corpuskit.operators import quality
from corpuskit.sources.files import describe
from workload.registry import query
from workload.tables import table

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    f"""SELECT doc_id, md5(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS clean, md5(lower(trim(regexp_replace(text, '{WS}', ' ', 'g')))) AS squashed FROM documents"""
)
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.collapse("text")).alias("clean"), F.md5(text.squash("text")).alias("squashed"))


# Specification lines made of a part's columns: standards in several spellings, with
# no-break blanks in some.
SPEC_SQL = """
specs AS (SELECT p_partkey AS id, p_name || ' to AS ' || (1000 + p_partkey % 700) || '.' || p_size || ', as/nzs' || chr(160) || ' ' || (2000 + p_size)
  || chr(8239) || 'Part ' || p_size || ' and AS' || p_size || '; see NSW' || chr(160) || 'Part ' || p_size || '.' || (p_partkey % 9) || '(a)(i) of the Housing Provisions, table '
  || p_size || ' of the ABCB Housing Provisions and Table ' || p_size || ' of the housing provisions; AS ' || (1000 + p_partkey % 700) || '.' || p_size AS text FROM part)"""


def specs(spark, sf):
    p = table(spark, sf, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        key.alias("id"),
        F.concat(
            "p_name", F.lit(" to AS "), (1000 + key % 700), F.lit("."), size, F.lit(", as/nzs\u00a0 "), (2000 + size), F.lit("\u202fPart "), size,
            F.lit(" and AS"), size, F.lit("; see NSW\u00a0Part "), size, F.lit("."), key % 9, F.lit("(a)(i) of the Housing Provisions, table "),
            size, F.lit(" of the ABCB Housing Provisions and Table "), size, F.lit(" of the housing provisions; AS "), (1000 + key % 700), F.lit("."), size,
        ).alias("text"),
    )


MENTION = citations.STANDARD_MENTION
MENTIONS_SQL = rf"""
mentions AS (SELECT id, ord, mention FROM (
  SELECT id, unnest(m) AS mention, unnest(range(len(m))) AS ord FROM (
    SELECT id, list_transform(regexp_extract_all(text, '{MENTION}'), lambda x: trim(regexp_replace(x, '{WS}', ' ', 'g'))) AS m FROM specs))
  QUALIFY row_number() OVER (PARTITION BY id, mention ORDER BY ord) = 1)"""
NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(upper({c}), '\bPART\s*(\d+)', '.\1', 'g'), '\s*/\s*', '/', 'g'), '" + WS.replace("{", "{{").replace("}", "}}") + r"', ' ', 'g'))"
SCHEDULE_SQL = f"""
schedule AS (SELECT {NORMAL.format(c="number")} AS key, max_by(number, id) AS standard, max_by(title, id) AS title FROM (
  SELECT s_suppkey AS id, 'AS ' || (1000 + s_suppkey % 700) || '.' || (s_suppkey % 50 + 1) AS number, s_name AS title FROM supplier
  UNION ALL SELECT s_suppkey, 'AS/NZS ' || (2000 + s_suppkey % 50) || ' Part ' || (s_suppkey % 50), s_name FROM supplier) GROUP BY 1)"""


def schedule(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    plain = F.concat(F.lit("AS "), (1000 + k % 700), F.lit("."), (k % 50 + 1))
    joint = F.concat(F.lit("AS/NZS "), (2000 + k % 50), F.lit(" Part "), k % 50)
    rows = s.select(k.alias("id"), F.explode(F.array(plain, joint)).alias("number"), F.col("s_name").alias("title"))
    keyed = rows.withColumn("key", citations.normalise_standard("number"))
    return keyed.groupBy("key").agg(F.max_by("number", "id").alias("standard"), F.max_by("title", "id").alias("title"))


@query(f"WITH {SPEC_SQL}, {MENTIONS_SQL} SELECT id, mention, {NORMAL.format(c='mention')} AS key FROM mentions")
def standard_mentions(spark, sf):
    found = specs(spark, sf).select("id", F.explode(citations.standard_mentions("text")).alias("mention"))
    return found.withColumn("key", citations.normalise_standard("mention"))


@query(
    f"""WITH {SPEC_SQL}, {MENTIONS_SQL}, {SCHEDULE_SQL} SELECT m.id, m.mention, s.standard, s.title
    FROM mentions m LEFT JOIN schedule s ON s.key = {NORMAL.format(c='m.mention')}"""
)
def standards_join(spark, sf):
    return cited_standards(specs(spark, sf), schedule(spark, sf)).select("id", "mention", "standard", "title")


JOINED_SQL = f"""WITH {SPEC_SQL}, {MENTIONS_SQL}, {SCHEDULE_SQL},
j AS (SELECT m.mention, s.standard FROM mentions m LEFT JOIN schedule s ON s.key = {NORMAL.format(c='m.mention')})"""


@query(JOINED_SQL + " SELECT count(standard) AS matched, count(DISTINCT mention) FILTER (standard IS NULL) AS unmatched FROM j")
def standards_coverage(spark, sf):
    return quality.standards_coverage(cited_standards(specs(spark, sf), schedule(spark, sf)))


@query(JOINED_SQL + " SELECT DISTINCT mention FROM j WHERE standard IS NULL")
def unmatched_standards(spark, sf):
    return quality.unmatched_standards(cited_standards(specs(spark, sf), schedule(spark, sf)))


PROSE = citations.PROSE_CITATION
CITED_SQL = rf"""
cited AS (SELECT id, label, number, display, raw_text FROM (
  SELECT id, ord, raw_text, lower(word) AS label, number, upper(word[1]) || lower(word[2:]) || ' ' || number || suffix AS display FROM (
    SELECT id, unnest(range(len(r))) AS ord, unnest(r) AS raw_text, unnest(w) AS word, unnest(n) AS number, unnest(s) AS suffix FROM (
      SELECT id, regexp_extract_all(text, '{PROSE}', 0) AS r, regexp_extract_all(text, '{PROSE}', 1) AS w,
        regexp_extract_all(text, '{PROSE}', 2) AS n, regexp_extract_all(text, '{PROSE}', 3) AS s FROM specs)))
  QUALIFY row_number() OVER (PARTITION BY id, display ORDER BY ord) = 1),
numbers AS (SELECT label, number, min(guid) AS guid FROM (
  SELECT 'part' AS label, p_size || '.' || (p_partkey % 9) AS number, p_partkey AS guid FROM part
  UNION ALL SELECT 'table', CAST(s_suppkey AS VARCHAR), s_suppkey FROM supplier) GROUP BY 1, 2 HAVING count(*) = 1)"""


def numbers(spark, sf):
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    parts = p.select(F.lit("part").alias("label"), F.concat("p_size", F.lit("."), F.col("p_partkey") % 9).alias("number"), F.col("p_partkey").alias("t_guid"))
    tables = s.select(F.lit("table"), F.col("s_suppkey").cast("string"), F.col("s_suppkey"))
    return unique_numbers(parts.union(tables))


@query(f"WITH {SPEC_SQL}, {CITED_SQL} SELECT c.id, c.display, c.raw_text, n.guid FROM cited c LEFT JOIN numbers n ON n.label = c.label AND n.number = c.number")
def prose_citations(spark, sf):
    found = cited_in_prose(specs(spark, sf), numbers(spark, sf))
    return found.select("id", "display", "raw_text", F.col("t_guid").alias("guid"))


@query(f"WITH {SPEC_SQL}, {CITED_SQL} SELECT label, number, guid FROM numbers")
def unique_number_join(spark, sf):
    return numbers(spark, sf).select("label", "number", F.col("t_guid").alias("guid"))


@query(f"WITH {SPEC_SQL}, {CITED_SQL} SELECT count(n.guid) AS resolved, count(*) - count(n.guid) AS unresolved FROM cited c LEFT JOIN numbers n ON n.label = c.label AND n.number = c.number")
def prose_resolution(spark, sf):
    return quality.resolution(cited_in_prose(specs(spark, sf), numbers(spark, sf)).select(F.col("t_guid").alias("chunk_id")))


@query(
    """WITH m AS (SELECT l_returnflag AS style, l_linenumber - 1 AS i, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS depth, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT style, i, depth, n, CASE WHEN style = 'A' THEN chr(97 + i) WHEN style = 'N' OR depth = 0 THEN CAST(i + 1 AS VARCHAR)
      ELSE ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'][i + 1] END AS marker FROM m"""
)
def list_markers(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("style"), (F.col("l_linenumber") - 1).alias("i"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("depth")
    ).agg(F.count(F.lit(1)).alias("n"))
    style = F.when(F.col("style") == "A", "alpha").when(F.col("style") == "N", "numbered")
    return rows.withColumn("marker", markers.list_marker(style, "i", "depth"))


@query(
    """WITH a AS (SELECT o_orderkey, 'Class ' || (o_custkey % 10) || ', Class 9c,,' || o_orderpriority AS building,
      'Climate zone ' || (o_custkey % 8) || ', none, zone' || o_orderpriority AS climate FROM orders)
    SELECT o_orderkey, array_to_string(list_transform(list_filter(string_split(building, ','), lambda x: trim(x) <> ''), lambda x: trim(regexp_replace(trim(x), '^Class ', ''))), '|') AS classes,
      array_to_string(list_filter(list_transform(string_split(climate, ','), lambda x: regexp_extract(x, '\\d+')), lambda x: x <> ''), '|') AS zones FROM a""".replace("\\\\d", "\\d")
)
def applicability_attributes(spark, sf):
    o = table(spark, sf, "orders")
    building = F.concat(F.lit("Class "), F.col("o_custkey") % 10, F.lit(", Class 9c,,"), "o_orderpriority")
    climate = F.concat(F.lit("Climate zone "), F.col("o_custkey") % 8, F.lit(", none, zone"), "o_orderpriority")
    return o.select(
        "o_orderkey", F.array_join(text.building_classes(building), "|").alias("classes"),
        F.array_join(F.transform(text.climate_zones(climate), lambda z: z.cast("string")), "|").alias("zones"),
    )


FILES_SQL = """files AS (SELECT p_partkey AS id, 'drawings/' || lower(p_type) || '/figure-' || p_size || '.' || (p_partkey % 9) || CASE WHEN p_partkey % 2 = 0 THEN '.PNG' ELSE '.tar.svg' END AS path,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE ' Figure ' || p_size || '.' || (p_partkey % 9) || 'a: ' || p_name END AS heading, p_name AS title, nullif(p_brand, 'Brand#2') AS description FROM part)"""


def files(spark, sf):
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.select(
        k.alias("id"),
        F.concat(F.lit("drawings/"), F.lower("p_type"), F.lit("/figure-"), size, F.lit("."), k % 9, F.when(k % 2 == 0, ".PNG").otherwise(".tar.svg")).alias("path"),
        F.when(size % 3 != 0, F.concat(F.lit(" Figure "), size, F.lit("."), k % 9, F.lit("a: "), "p_name")).alias("heading"),
        F.col("p_name").alias("title"), F.nullif("p_brand", F.lit("Brand#2")).alias("description"),
    )


@query(
    rf"""WITH {FILES_SQL} SELECT id, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS stem,
      regexp_extract(path, '(\.[^./]+)$', 1) AS suffix, regexp_replace(path, '[^A-Za-z0-9._-]', '_', 'g') AS safe,
      nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '(?i)^figure-(.+?)\.png$', 1), '') AS file_number,
      nullif(regexp_extract(trim(heading), '(?i)^figure\s+([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)', 1), '') AS heading_number,
      concat_ws(chr(10) || chr(10), title, description) AS figure_text FROM files"""
)
def file_and_figure_names(spark, sf):
    name = text.basename("path")
    return files(spark, sf).select(
        "id", name.alias("name"), text.stem("path").alias("stem"), text.suffix("path").alias("suffix"), text.safe_name("path").alias("safe"),
        text.figure_number_from_file(name).alias("file_number"), text.figure_number_from_heading("heading").alias("heading_number"),
        text.figure_text("title", "description").alias("figure_text"),
    )


# The same language as the caption pattern without look-ahead: a number has a
# digit in one of its segments.
CAPTION_RE2 = (
    r"(?i)^\s*(figure|fig\.?|table|diagram|drawing|detail|photo|image|plate|sketch|appendix)\s*"
    r"((?:[A-Za-z]+[.\-])*[A-Za-z]*\d[A-Za-z0-9]*(?:[.\-][A-Za-z0-9]+)*)?(?:\s*\(([^)]{0,40})\))?\s*([:.–—-]\s*)?(.*)$"
)
CAPTIONS_SQL = """captions AS (SELECT p_partkey AS id, CASE p_type WHEN 'STANDARD' THEN 'Figure H' || p_size || 'D4a (explanatory): ' || p_name
  WHEN 'ECONOMY' THEN 'Fig. ' || p_size || '.' || (p_partkey % 9) || ' - ' || p_name WHEN 'MEDIUM' THEN 'Figures are indicative of ' || p_name
  WHEN 'LARGE' THEN 'Table ' || p_size WHEN 'PROMO' THEN 'See Figure ' || p_size || '.' ELSE 'Figure A-' || p_size || ' shows ' || p_name END AS text FROM part)"""


def captioned(spark, sf):
    kind, size, name = F.col("p_type"), F.col("p_size"), F.col("p_name")
    made = (
        F.when(kind == "STANDARD", F.concat(F.lit("Figure H"), size, F.lit("D4a (explanatory): "), name))
        .when(kind == "ECONOMY", F.concat(F.lit("Fig. "), size, F.lit("."), F.col("p_partkey") % 9, F.lit(" - "), name))
        .when(kind == "MEDIUM", F.concat(F.lit("Figures are indicative of "), name))
        .when(kind == "LARGE", F.concat(F.lit("Table "), size))
        .when(kind == "PROMO", F.concat(F.lit("See Figure "), size, F.lit(".")))
        .otherwise(F.concat(F.lit("Figure A-"), size, F.lit(" shows "), name))
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), made.alias("text"))


@query(
    f"""WITH {CAPTIONS_SQL}, g AS (SELECT id, regexp_extract(text, '{CAPTION_RE2}', 1) AS kind, regexp_extract(text, '{CAPTION_RE2}', 2) AS number,
      regexp_extract(text, '{CAPTION_RE2}', 3) AS qualifier, regexp_extract(text, '{CAPTION_RE2}', 4) AS sep, regexp_extract(text, '{CAPTION_RE2}', 5) AS title FROM captions)
    SELECT id, kind, number, qualifier, sep, title, kind <> '' AND (number <> '' OR sep <> '' OR title = '') AS is_caption,
      lower(kind) IN ('figure', 'fig', 'fig.') AND number <> '' AND (sep <> '' OR qualifier <> '') AS is_figure FROM g"""
)
def caption_grammar(spark, sf):
    return captioned(spark, sf).select(
        "id", captions.caption_parts("text").alias("p"), captions.looks_like_caption("text").alias("is_caption"),
        captions.is_figure_caption("text").alias("is_figure"),
    ).select("id", "p.*", "is_caption", "is_figure")


@query(
    """SELECT doc_id, md5(CASE WHEN length(t) > 5000 THEN substr(t, 1, 5000) || chr(10) || chr(10) || '[... document truncated at 5,000 characters ...]' ELSE t END) AS body
    FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)""".replace("\\\\", "\\")
)
def truncated_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.truncate_document("text", 5000)).alias("body"))


@query(
    """SELECT doc_id, md5(text) AS plain, md5(CASE WHEN lang = 'en' OR source = '' THEN text ELSE source || chr(10) || chr(10) || text END) AS headed FROM documents"""
)
def embedding_content(spark, sf):
    d = table(spark, sf, "documents").withColumn("heading", F.when(F.col("lang") != "en", F.col("source")))
    return d.select("doc_id", F.md5(text.embedding_content("text", "heading")).alias("plain"), F.md5(text.embedding_content("text", "heading", True)).alias("headed"))


@query(
    """SELECT a.vec_id AS vec_id, b.vec_id AS other, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.label"""
)
def cosine_distance(spark, sf):
    a = table(spark, sf, "embeddings")
    b = a.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    joined = a.join(b, F.col("label") == F.col("other"))
    return joined.select("vec_id", "other", (F.round(vectors.cosine_distance("embedding", "e2"), 6) + 0.0).alias("distance"))


@query(
    """SELECT vec_id, len(v) AS dim, round(n, 6) AS norm, round(list_min(v), 6) AS smallest, round(list_max(v), 6) AS largest, abs(n - 1) < 1e-3 AS is_unit
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"""
)
def vector_profile(spark, sf):
    p = table(spark, sf, "embeddings").select("vec_id", vectors.profile("embedding").alias("p")).select("vec_id", "p.*")
    for name in ("norm", "smallest", "largest"):
        p = p.withColumn(name, F.round(name, 6))
    return p.withColumn("dim", F.col("dim").cast("long"))


@query("SELECT vec_id, i, round(x::DOUBLE, 7) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)")
def vector_rounding(spark, sf):
    rounded = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.round_vector("embedding")).alias("i", "x"))
    return rounded.select("vec_id", F.col("i").cast("long").alias("i"), "x")


@query(
    """WITH s AS (SELECT s_suppkey AS k, 'fig' || (s_suppkey % 60) || CASE WHEN s_suppkey % 3 = 0 THEN '.png' ELSE '.svg' END AS name,
      'fig' || (s_suppkey % 60) AS stem, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS text FROM supplier),
    e AS (SELECT name, max_by(text, k) AS text FROM s GROUP BY name), t AS (SELECT stem, min_by(text, k) AS text FROM s GROUP BY stem)
    SELECT p_partkey AS id, coalesce(nullif(e.text, ''), t.text) AS description FROM part
    LEFT JOIN e ON e.name = 'fig' || p_partkey || '.svg' LEFT JOIN t ON t.stem = 'fig' || p_partkey"""
)
def description_lookup(spark, sf):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("fig"), k % 60, F.when(k % 3 == 0, ".png").otherwise(".svg"))
    additions = table(spark, sf, "supplier").select(
        text.basename(name).alias("name"), text.stem(name).alias("stem"), F.when(k % 7 == 0, "").otherwise(F.col("s_name")).alias("text"), k.alias("at")
    )
    figures = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("fig"), "p_partkey", F.lit(".svg")).alias("file_name"))
    return describe(figures, "file_name", additions).select("id", "description")
