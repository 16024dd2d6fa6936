"""Codes of many documents made of parts and suppliers: every chunk builder, every
kind of reference, and the report of the ingest."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from corpuskit.operators.chunking import build_chunks, figures
from corpuskit.operators.ranking import union_all
from corpuskit.operators.references import build_references, nest_references
from corpuskit.plans.ingest import ingest_report
from corpuskit.session import stored
from corpuskit.sources.structured import parse_pieces
from workload.registry import query
from workload.tables import table


def _markup(template: str, **values):
    """Text with {name} places as a column."""
    pieces, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(before), values[name].cast("string")]
    return F.concat(*pieces, F.lit(rest))


PART = (
    '<clause id="_c{k}" building="Class {z}" climate="Climate zone {z}"><sptc>C{k}</sptc><title>{n}</title>'
    '<subclause id="_s{k}" num="1"><content><num>(1) </num><p>Fit {n} to AS {m}.{z} as a <a href="#_g{z}" type="abcb-glossentry">kind</a>, see '
    '<a href="#_c{q}" type="clause">C{q}</a>, <a href="#_hx{h}" publishing-id="std" type="clause">code {h}</a> and '
    '<a href="#_f{k}" type="image-reference">figure</a>; Part 9.{r} of the Housing Provisions.</p>'
    '<ol class="alpha"><li>first</li><li>second<ol><li>deep</li></ol></li></ol></content>'
    '<subclause-variation id="_v{k}" state="NSW" num="2"><content><p>In NSW only {n}.</p></content></subclause-variation></subclause>'
    '<callout id="_k{k}" callout-type="explanatory"><content><p>Note on {n}.</p></content></callout></clause>'
    '<table-reference id="_t{k}" num="{k}" sptc="C{k}"><title>Sizes</title><table><thead><tr><th>Part</th><th>Size</th></tr></thead>'
    "<tbody><tr><td>{n}</td><td>{z}</td></tr></tbody></table></table-reference>"
    '<image-reference id="_f{k}" num="{k}"><title>{n}</title><img src="f{k}.svg"/></image-reference>'
)
STANDARD = (
    '<part num="9.{r}" id="_hp{h}"><title>Part of {h}</title></part>'
    '<clause id="_hx{h}"><sptc>9.{h}</sptc><title>Treads</title><subclause id="_hs{h}" num="1"><content><p>Treads.</p></content></subclause></clause>'
)


def _brand():
    return F.replace("p_brand", F.lit("#"), F.lit(""))


def _brands(spark, sf):
    return table(spark, sf, "part").select(_brand().alias("corpus")).distinct()


def _pieces(spark, sf):
    """A document per brand, and one of standards with the glossary and the schedule,
    in pieces: a document grows with the tables, and no row holds one."""
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    k, z, h = F.col("p_partkey"), F.col("p_size"), F.col("s_suppkey")
    brands, once = _brands(spark, sf), spark.range(1)

    def pieces(document, corpus, section, rows, content, key=F.lit(0)):
        place = F.struct(F.lit(section).alias("section"), key.cast("long").alias("key"))
        return rows.select(corpus.alias("corpus"), F.lit(document).alias("document"), place.alias("place"), content.alias("content"))

    volume, standard = partial(pieces, "volume"), partial(pieces, "standard", F.lit("std"))
    b = F.col("corpus")
    head = F.concat(F.lit('<volume publishing-id="'), b, F.lit('"><part num="P" id="_p'), b, F.lit('"><title>'), b, F.lit("</title>"))
    item = _markup(PART, k=k, z=z, n=F.col("p_name"), m=1000 + k % 700, q=k + 7, h=k % 150, r=k % 40)
    foot = F.concat(F.lit('</part><part-variation id="_pv'), b, F.lit('" type="DELETE" state="TAS" num="P"><content><p>Not in TAS.</p></content></part-variation></volume>'))
    row = _markup("<tr><td>AS {m}.{z}</td><td>2010</td><td>{n}</td></tr>", m=1000 + h, z=h % 50 + 1, n=F.col("s_name"))
    term = _markup('<glossentry id="_g{z}"><glossterm>term {z}</glossterm><glossdef><content><p>A size.</p></content></glossdef></glossentry>', z=z)
    return union_all([
        volume(b, 0, brands, head), volume(_brand(), 1, p, item, k), volume(b, 2, brands, foot),
        standard(0, once, F.lit('<standard publishing-id="std">')),
        standard(1, s, _markup(STANDARD, h=h, r=h % 60)),
        standard(2, once, F.lit('<table-reference id="_sched"><title>Schedule of referenced documents</title><table><tbody>')),
        standard(3, s, row),
        standard(4, once, F.lit("</tbody></table></table-reference>")),
        standard(5, p.select("p_size").distinct(), term),
        standard(6, once, F.lit("</standard>")),
    ])


def _nodes(spark, sf):
    corpora = _brands(spark, sf).unionByName(spark.range(1).select(F.lit("std").alias("corpus")))
    corpora = corpora.select("corpus", F.col("corpus").alias("doc_label"), F.when(F.col("corpus") == "std", 99).otherwise(0).alias("corpus_ord"))
    return parse_pieces(_pieces(spark, sf), corpora)


def _built(spark, sf):
    """(nodes, images, chunks) of the documents, each stored once."""
    nodes = stored(_nodes(spark, sf))
    images = table(spark, sf, "part").where("p_partkey % 2 = 0").select(_brand().alias("corpus"), F.concat(F.lit("f"), "p_partkey", F.lit(".svg")).alias("filename"))
    return nodes, images, stored(build_chunks(nodes, images))


def _ingested(spark, sf):
    """(nodes, images, chunks, edges)."""
    nodes, images, chunks = _built(spark, sf)
    return nodes, images, chunks, stored(build_references(nodes, chunks, images, "std"))


P = """p AS (SELECT p_partkey AS k, p_size AS z, p_name AS n, replace(p_brand, '#', '') AS b, 1000 + p_partkey % 700 AS m, p_partkey + 7 AS q, p_partkey % 150 AS h, p_partkey % 40 AS r FROM part)"""
TEXT = """'(1) Fit ' || n || ' to AS ' || m || '.' || z || ' as a kind, see C' || q || ', code ' || h || ' and figure; Part 9.' || r || ' of the Housing Provisions.' || chr(10) || '(a) first' || chr(10) || '(b) second' || chr(10) || '  (i) deep'"""


@query(
    f"""WITH {P}, b AS (SELECT DISTINCT b FROM p), s AS (SELECT s_suppkey AS h, s_name AS n FROM supplier), rows AS (
    SELECT 's' || k AS id, 'subclause' AS node_type, 'C' || k AS clause_id, b || ' > P ' || b || ' > C' || k || ' > C' || k || '(1)' AS path, n AS heading, {TEXT} AS text, CAST(z AS VARCHAR) AS classes, NULL AS states, NULL AS note FROM p
    UNION ALL SELECT 'v' || k, 'subclause', 'C' || k, b || ' > P ' || b || ' > C' || k || ' > C' || k || '(2)', n, 'In NSW only ' || n || '.', CAST(z AS VARCHAR), 'NSW', NULL FROM p
    UNION ALL SELECT 'k' || k, 'note', 'C' || k, b || ' > P ' || b || ' > C' || k, 'Note (explanatory)', 'Note on ' || n || '.', '', NULL, NULL FROM p
    UNION ALL SELECT 't' || k, 'table', 'C' || k, b || ' > P ' || b, 'Table ' || k || ': Sizes', 'Sizes' || chr(10) || 'Part | Size' || chr(10) || n || ' | ' || z, '', NULL, NULL FROM p
    UNION ALL SELECT 'f' || k, 'figure', NULL, b || ' > P ' || b, 'Figure ' || k || ': ' || n, n, '', NULL, NULL FROM p
    UNION ALL SELECT 'p' || b, 'part', 'P', b, 'P ' || b, b, '', NULL, NULL FROM b
    UNION ALL SELECT 'pv' || b, 'note', 'P', b, 'Part P variation (TAS)', 'Not in TAS.', '', 'TAS', 'DELETE' FROM b
    UNION ALL SELECT 'hp' || h, 'part', '9.' || (h % 60), 'std', '9.' || (h % 60) || ' Part of ' || h, 'Part of ' || h, '', NULL, NULL FROM s
    UNION ALL SELECT 'hs' || h, 'subclause', '9.' || h, 'std > 9.' || h || ' > 9.' || h || '(1)', 'Treads', 'Treads.', '', NULL, NULL FROM s
    UNION ALL SELECT 'sched', 'table', NULL, 'std', 'Schedule of referenced documents', 'Schedule of referenced documents' || chr(10) || string_agg('AS ' || (1000 + h) || '.' || (h % 50 + 1) || ' | 2010 | ' || n, chr(10) ORDER BY '<tr><td>AS ' || (1000 + h) || '.' || (h % 50 + 1)), '', NULL, NULL FROM s
    UNION ALL SELECT 'g' || z, 'glossary', NULL, 'std', 'term ' || z, 'A size.', '', NULL, NULL FROM (SELECT DISTINCT z FROM p))
    SELECT id, node_type, clause_id, path, heading, md5(text) AS text_md5, classes, states, note FROM rows"""
)
def chunk_builders(spark, sf):
    return _built(spark, sf)[2].select(
        "id", "node_type", "clause_id", F.array_join("hierarchy", " > ").alias("path"), "heading", F.md5("text").alias("text_md5"),
        F.array_join("building_classes", ",").alias("classes"), F.array_join("jurisdictions", ",").alias("states"), F.col("applicability_note").alias("note"),
    )


EDGES_SQL = f"""{P}, hp AS (SELECT s_suppkey % 60 AS r, min(s_suppkey) AS h FROM supplier GROUP BY 1 HAVING count(*) = 1),
edges AS (
  SELECT 's' || k AS id, 'cross_refs' AS list, NULL AS kind, NULL AS clause_id, unnest(['kind', 'C' || q, 'code ' || h, 'figure']) AS raw_text, NULL AS chunk_id, NULL AS standard, NULL AS title, NULL AS filename FROM p
  UNION ALL SELECT 's' || k, 'defined_terms', NULL, NULL, 'term ' || z, NULL, NULL, NULL, NULL FROM p
  UNION ALL SELECT 's' || p.k, 'internal_refs', NULL, 'C' || p.q, NULL, 's' || t.k, NULL, NULL, NULL FROM p LEFT JOIN p t ON t.k = p.q
  UNION ALL SELECT 's' || k, 'external_refs', 'std', CASE WHEN s_suppkey IS NULL THEN 'code ' || h ELSE '9.' || h END, 'code ' || h, 'hs' || s_suppkey, NULL, NULL, NULL FROM p LEFT JOIN supplier ON s_suppkey = h
  UNION ALL SELECT 's' || k, 'external_refs', 'standard', NULL, NULL, NULL, 'AS ' || m || '.' || z, s_name, NULL FROM p LEFT JOIN supplier ON 1000 + s_suppkey = m AND s_suppkey % 50 + 1 = z
  UNION ALL SELECT 's' || k, 'external_refs', 'housing', 'Part 9.' || p.r, 'Part 9.' || p.r || ' of the Housing Provisions', 'hp' || hp.h, NULL, NULL, NULL FROM p LEFT JOIN hp ON hp.r = p.r
  UNION ALL SELECT 's' || k, 'image_refs', NULL, NULL, 'figure', NULL, NULL, NULL, 'f' || k || '.svg' FROM p WHERE k % 2 = 0
  UNION ALL SELECT 'f' || k, 'image_refs', NULL, NULL, 'Figure ' || k || ': ' || n, NULL, NULL, NULL, 'f' || k || '.svg' FROM p WHERE k % 2 = 0)"""


@query(f"WITH {EDGES_SQL} SELECT id, list, kind, clause_id, raw_text, chunk_id, standard, title, filename FROM edges")
def reference_edges(spark, sf):
    _, _, chunks, edges = _ingested(spark, sf)
    named = edges.where("corpus <> 'std'").join(chunks.select("corpus", "pre", "id"), ["corpus", "pre"])
    return named.select("id", "list", "kind", "clause_id", "raw_text", "chunk_id", "standard", "title", "filename")


@query(
    f"""WITH {EDGES_SQL} SELECT 's' || p.k AS id, 'kind|C' || q || '|code ' || h || '|figure' AS cross, 'term ' || z AS terms, 'C' || q || '=' || coalesce(i.chunk_id, '') AS internal,
    CASE WHEN p.k % 2 = 0 THEN 'f' || p.k || '.svg' ELSE '' END AS images, 3 AS external FROM p JOIN edges i ON i.id = 's' || p.k AND i.list = 'internal_refs'"""
)
def nested_references(spark, sf):
    _, _, chunks, edges = _ingested(spark, sf)
    nested = nest_references(chunks.where("corpus <> 'std' AND id LIKE 's%'"), edges)
    pair = lambda r: F.concat(r["clause_id"], F.lit("="), F.coalesce(r["chunk_id"], F.lit("")))
    return nested.select(
        "id", F.array_join("cross_refs", "|").alias("cross"), F.array_join("defined_terms", "|").alias("terms"), F.array_join(F.transform("internal_refs", pair), "|").alias("internal"),
        F.array_join(F.transform("image_refs", lambda r: r["filename"]), "|").alias("images"), F.size("external_refs").alias("external"),
    )


@query(
    f"""WITH {EDGES_SQL}
    SELECT 'internal_refs' AS section, count(chunk_id) AS resolved, count(*) - count(chunk_id) AS unresolved FROM edges WHERE list = 'internal_refs'
    UNION ALL SELECT 'prose_citations', count(chunk_id), count(*) - count(chunk_id) FROM edges WHERE kind = 'housing'
    UNION ALL SELECT 'images', count(*) FILTER (k % 2 = 0), count(*) FILTER (k % 2 <> 0) FROM p"""
)
def ingest_reports(spark, sf):
    nodes, images, chunks, edges = _ingested(spark, sf)
    report = ingest_report(chunks, edges, figures(nodes, images)).where(F.col("section").isin("internal_refs", "prose_citations", "images"))
    body = F.from_json("body", "resolved long, unresolved long, images_matched long, images_unmatched long")
    return report.select(
        "section", F.coalesce(body["resolved"], body["images_matched"]).alias("resolved"), F.coalesce(body["unresolved"], body["images_unmatched"]).alias("unresolved")
    )
