"""Structured documents: elements, rendering, chunks, references, report."""

import json

import pytest
from pyspark.sql import functions as F

from corpuskit.functions.text import WHITESPACE, collapse
from corpuskit.operators.chunking import build_chunks
from corpuskit.operators.references import build_references, nest_references
from corpuskit.operators.rendering import content_texts
from corpuskit.plans.ingest import ingest_documents
from corpuskit.session import CLEANUP, cut_lineage, stored
from corpuskit.sources.structured import STEP, Corpus, corpora_table, parse_documents, parse_pieces, scan_documents
from workload import code_queries

MAIN = """<volume publishing-id="main"><ncc-section num="A" id="_s1"><title>General</title>
<part num="A1" id="_p1" state=""><title>Scope</title>
<intro-part><content><p>About <b>this</b> part.</p></content></intro-part>
<clause id="_c1" building="Class 2, Class 9c,," climate="Climate zone 1,none,Climate zone 12"><sptc>A1D1</sptc><title>Walls</title>
  <subclause id="_sc1" num="1"><content><num>(1) </num><p>Walls must <a href="#_g1" type="abcb-glossentry">be fire walls</a> to AS 1684 Part 2.</p>
    <ol class="alpha"><li>first <i>item</i> here<ol><li>deep one</li><li>deep two</li></ol> after</li><li>second</li></ol>
    <section><title>Limits</title><p>Inner.</p><equation-block><mi>x</mi><mo>=</mo><mn>2</mn></equation-block></section>
    <p>See <a href="#_sc2" type="subclause">the next</a>, <a href="#_c2" type="clause">A1D2</a>, <a href="#_hx" publishing-id="housing" type="clause">H link</a>,
    <a href="#_f1" type="image-reference">the figure</a>, <a href="http://x.org">site</a>, <a href="#_zz" type="clause">nowhere</a>,
    <a href="#_g1" type="abcb-glossentry">fire walls</a>.</p></content>
    <subclause-variation id="_sv1" state="NSW" num="1a"><content><p>In NSW.</p></content></subclause-variation></subclause>
  <subclause id="_sc2" num="2" title="Own title"><content><p>Refer to Part 9.6 of the ABCB Housing Provisions, twice: Part 9.6 of the Housing Provisions; Section 4 of the Housing Provisions.</p></content></subclause>
  <callout id="_k1" callout-type="explanatory"><content><p>Because.</p></content></callout>
  <clause-variation id="_cv1" state="TAS" sptc="A1D1"><title>Tas walls</title><content><p>Left blank.</p></content>
    <clause-variation id="_cv2" state="SA" sptc="A1D1"><title>SA walls</title><subclause id="_sc9"><content><p>Nested.</p></content></subclause></clause-variation>
  </clause-variation>
</clause>
<clause id="_c2"><sptc>A1D2</sptc><title>Bare</title><callout id="_k2"><content><p>Only a note.</p></content></callout></clause>
<clause id="_c3"><sptc>A1D3</sptc><title>Whole</title><content><p>Whole text.</p></content></clause>
<part-variation id="_pv1" type="DELETE" state="TAS" num="A1"><content><p>Not in TAS.</p></content></part-variation>
<table-reference id="_t1" num="3" sptc="A1D1"><title>Loads</title><table><thead><tr><th>Kind</th><th>kPa</th></tr></thead>
<tbody><tr><td>Floor</td><td> 2 <b>or</b> 3</td></tr><tr><td> </td><td></td></tr></tbody></table></table-reference>
<table-reference id="_t2"><title>Schedule of referenced documents</title><table><tbody>
<tr><td>AS 1684 Part 2</td><td>2010</td><td>Timber</td></tr><tr><td>AS 1</td><td>x</td></tr></tbody></table></table-reference>
<image-reference id="_f1" num="A1a"><title>Wall</title><img src="wall.svg"/></image-reference>
<image-reference id="_f2" num="A1b"><title>Gone</title><img src="gone.svg"/></image-reference>
</part></ncc-section>
<glossentry id="_g1"><glossterm>fire wall</glossterm><glossdef><content><p>A wall that—</p></content><content><ol><li>stands.</li></ol></content></glossdef></glossentry>
</volume>"""

HOUSING = """<standard publishing-id="housing"><part num="9.6" id="_hp"><title>Stairs</title></part>
<part num="1" id="_dup1"><title>One</title></part><part num="1" id="_dup2"><title>Uno</title></part>
<clause id="_hx"><sptc>9.6.1</sptc><title>Treads</title><subclause id="_hs" num="1"><content><p>Treads.</p></content></subclause></clause>
<glossentry id="_g1"><glossterm>fire wall (housing)</glossterm><glossdef><content><p>Other.</p></content></glossdef></glossentry></standard>"""


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    (folder / "main.xml").write_text(MAIN, encoding="utf-8")
    (folder / "housing.xml").write_text(HOUSING, encoding="utf-8")
    corpora = corpora_table(
        spark, [Corpus("main", "Main Code", str(folder / "main.xml")), Corpus("housing", "Housing", str(folder / "housing.xml"))]
    )
    images = spark.createDataFrame([("main", "wall.svg")], "corpus string, filename string")
    descriptions = spark.createDataFrame([("wall.png", "wall", "A wall drawn.", 1)], "name string, stem string, text string, at int")
    chunks, edges, report = ingest_documents(spark, corpora, [str(folder)], images, "housing", descriptions)
    nodes = scan_documents(spark, corpora, [str(folder)])
    return {r["id"]: r for r in chunks.where("corpus = 'main'").collect()}, chunks, edges, report, nodes, images


def test_elements_keep_mixed_content(ingested):
    nodes = ingested[4]
    li = nodes.where("tag = 'li' AND text LIKE 'first%'").first()
    assert li["text"] == "first " and li["tag_ord"] == 0
    deep = nodes.where("tag = 'i'").first()
    assert deep["tail"] == " here"
    clause = nodes.where("node_id = '_c1'").first()
    inside = nodes.where((F.col("corpus") == "main") & F.col("pre").between(clause["pre"], clause["last"])).count()
    assert inside == nodes.where(F.array_contains("pre_path", clause["pre"]) & (F.col("corpus") == "main")).count()


def test_subclause_text(ingested):
    text = ingested[0]["sc1"]["text"].split("\n")
    assert text == [
        "(1) Walls must be fire walls to AS 1684 Part 2.",
        "(a) first item here after",
        "  (i) deep one",
        "  (ii) deep two",
        "(b) second",
        "Limits:",
        "Inner.",
        "x=2",
        "See the next, A1D2, H link, the figure, site, nowhere, fire walls.",
    ]


def test_clause_family(ingested):
    c = ingested[0]
    sc1 = c["sc1"]
    assert sc1["clause_id"] == "A1D1" and sc1["heading"] == "Walls" and sc1["doc"] == "Main Code"
    assert sc1["hierarchy"] == ["Main Code", "A General", "A1 Scope", "A1D1", "A1D1(1)"]
    assert sc1["building_classes"] == ["2", "9c"] and sc1["climate_zones"] == [1, 12] and sc1["jurisdictions"] is None
    assert c["sv1"]["jurisdictions"] == ["NSW"] and c["sc2"]["heading"] == "Own title"
    assert (c["k1"]["node_type"], c["k1"]["heading"], c["k1"]["building_classes"]) == ("note", "Note (explanatory)", [])
    assert c["k2"]["heading"] == "Note"
    assert "cv1" not in c  # it holds a nested variation, which is emitted instead
    assert c["sc9"]["jurisdictions"] == ["SA"] and c["sc9"]["heading"] == "SA walls"
    assert (c["c3"]["node_type"], c["c3"]["text"]) == ("clause", "Whole text.")
    assert "c1" not in c and "c2" not in c


def test_standalone_chunks(ingested):
    c = ingested[0]
    assert (c["p1"]["heading"], c["p1"]["text"], c["p1"]["clause_id"]) == ("A1 Scope", "About this part.", "A1")
    pv = c["pv1"]
    assert (pv["heading"], pv["jurisdictions"], pv["applicability_note"]) == ("Part A1 variation (TAS)", ["TAS"], "DELETE")
    assert c["t1"]["heading"] == "Table 3: Loads" and c["t1"]["text"] == "Loads\nKind | kPa\nFloor | 2 or 3"
    assert c["f1"]["text"] == "Wall\n\nA wall drawn." and c["f1"]["heading"] == "Figure A1a: Wall"
    assert [r.asDict() for r in c["f1"]["image_refs"]] == [
        {"image_id": "f1", "filename": "wall.svg", "caption": "Figure A1a: Wall", "described": True}
    ]
    assert c["f2"]["image_refs"] == [] and c["f2"]["text"] == "Gone"
    assert c["g1"]["text"] == "A wall that—\n(1) stands." and c["g1"]["heading"] == "fire wall"


def test_every_id_once(ingested):
    ids = [r["id"] for r in ingested[1].where("corpus = 'main'").collect()]
    assert len(ids) == len(set(ids))


def test_references(ingested):
    r = ingested[0]["sc1"]
    assert r["cross_refs"] == ["be fire walls", "the next", "A1D2", "H link", "the figure", "nowhere", "fire walls"]
    assert r["defined_terms"] == ["fire wall (housing)"]  # the last corpus words a shared guid, once
    assert [(x["clause_id"], x["chunk_id"]) for x in r["internal_refs"]] == [("the next", "sc2"), ("A1D2", "k2"), ("nowhere", None)]
    assert [(x["filename"], x["caption"], x["described"]) for x in r["image_refs"]] == [("wall.svg", "the figure", None)]
    ext = [(x["kind"], x["clause_id"], x["chunk_id"], x["standard"], x["title"]) for x in r["external_refs"]]
    assert ext == [("housing", "9.6.1", "hs", None, None), ("standard", None, None, "AS 1684 Part 2", "Timber")]


def test_prose_citations_resolve_only_unique_numbers(ingested):
    ext = [(x["clause_id"], x["chunk_id"]) for x in ingested[0]["sc2"]["external_refs"]]
    assert ext == [("Part 9.6", "hp"), ("Section 4", None)]


def test_report(ingested):
    body = {}
    for row in ingested[3].collect():
        body.setdefault(row["section"], []).append(json.loads(row["body"]))
    assert body["images"] == [
        {"images_matched": 1, "images_unmatched": 1, "figures_described": 1, "figures_undescribed": 0}
    ]
    assert body["image_gaps"] == [{"gap": "unmatched", "name": "gone.svg"}]
    assert body["internal_refs"] == [{"resolved": 2, "unresolved": 1}]
    assert body["prose_citations"] == [{"resolved": 1, "unresolved": 1}]
    # The mention in the clause and the one in the schedule's own row, plus the row "AS 1" which is no mention.
    assert body["standards"] == [{"matched": 2, "unmatched": 0}]


NESTED = """<volume publishing-id="m"><clause id="_c"><sptc>A</sptc><title>T</title><subclause id="_s" num="1">
<content><p>See <a href="#_c" type="clause">one</a>.</p></content>
<subclause-variation id="_v" state="NSW"><content><p>Or <a href="#_c" type="clause">two</a>.</p></content></subclause-variation>
</subclause></clause></volume>"""


def test_strict_references_leave_variations_their_own(spark):
    corpora = spark.createDataFrame([("m", "M", 0)], "corpus string, doc_label string, corpus_ord int")
    nodes = cut_lineage(parse_documents(spark.createDataFrame([("m", NESTED)], "corpus string, content string"), corpora))
    images = spark.createDataFrame([], "corpus string, filename string")
    chunks = cut_lineage(build_chunks(nodes, images))

    def crossed(strict):
        edges = build_references(nodes, chunks, images, "m", strict=strict).where("list = 'cross_refs'")
        return sorted((r["id"], r["raw_text"]) for r in edges.join(chunks.select("corpus", "pre", "id"), ["corpus", "pre"]).collect())

    assert crossed(False) == [("s", "one"), ("s", "two"), ("v", "two")]
    assert crossed(True) == [("s", "one"), ("v", "two")]


def test_elements_are_parsed_with_their_label_and_read_by_column(spark):
    """Nothing is joined to the elements, so none is moved, and a stored table is read
    by the columns that a reader names."""
    corpora = spark.createDataFrame([("m", "Main", 3), ("z", "Not there", 1)], "corpus string, doc_label string, corpus_ord int")
    documents = spark.createDataFrame([("m", '<a x="1" y="2"><b>one</b>tail</a>'), ("n", "<c/>"), (None, "<d/>")], "corpus string, content string")
    parsed = parse_documents(documents, corpora)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join")
    nodes = stored(parsed)
    assert nodes.schema == parsed.schema
    rows = [(r["corpus"], r["doc_label"], r["corpus_ord"], r["tag"], r["attrs"], r["tail"], r["tag_path"], r["pre_path"], r["parent"]) for r in nodes.orderBy("pre").collect()]
    assert rows == [("m", "Main", 3, "a", {"x": "1", "y": "2"}, "", ["a"], [0], None), ("m", "Main", 3, "b", {}, "tail", ["a", "b"], [0, 1], 0)]
    scan = nodes.where("tag = 'b'").select("pre")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<pre:bigint,tag:string>" in scan


def test_documents_in_pieces_are_parsed_like_whole_ones(spark):
    """Pieces come in any order and end anywhere; one is over a step long."""
    long = "<r>é&amp;" + "<b>x</b>y" * 3 + "z" * (STEP + 9) + '<c k="ü"/></r>'
    whole = {("m", 1): "<a>one<b/></a>", ("m", 2): "<a><b/>two</a>", ("n", 1): long, ("lost", 1): "<x/>", (None, 1): "<x/>"}
    corpora = spark.createDataFrame([("m", "Main", 1), ("m", "Again", 2), ("n", "Next", 3), ("none", "None", 4)], "corpus string, doc_label string, corpus_ord int")
    pieces = []
    for (corpus, document), text in whole.items():
        raw = text.encode()
        cuts = [0, 1, 4, 5, 11, len(raw)]
        pieces += [(corpus, document, n, bytearray(raw[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(corpus, document, 9, None)]
    cut = spark.createDataFrame(pieces[::-1], "corpus string, document int, place int, content binary").repartition(3)
    parsed = parse_pieces(cut, corpora)
    expected = parse_documents(spark.createDataFrame([(c, t) for (c, _), t in whole.items()], "corpus string, content string"), corpora)
    assert parsed.schema == expected.schema
    rows = [sorted(map(repr, df.collect())) for df in (parsed, expected)]
    assert rows[0] == rows[1] and len(rows[0]) == 2 * 2 + 2 * 2 + 5


def test_pieces_without_a_document_do_not_stop_the_others(spark):
    corpora = spark.createDataFrame([("m", "M", 0)], "corpus string, doc_label string, corpus_ord int")
    none = spark.createDataFrame([("m", 1, 1, None)], "corpus string, document int, place int, content string")
    assert parse_pieces(none, corpora).count() == 0
    with pytest.raises(Exception, match="no element found|not well-formed|unclosed"):
        parse_pieces(spark.createDataFrame([("m", 1, 1, "<a><b>")], none.schema), corpora).count()


def test_no_row_holds_a_document_that_grows(spark, tmp_path):
    """A brand's parts and all suppliers make one document each; none is put together."""
    spark.range(400).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "'Brand#1' AS p_brand", "CAST(id % 9 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(400).selectExpr("id AS s_suppkey", "concat('maker ', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    assert code_queries._pieces(spark, str(tmp_path)).agg(F.max(F.length("content"))).first()[0] < 3000
    nodes = code_queries._nodes(spark, str(tmp_path))
    assert {r["corpus"]: r["n"] for r in nodes.where("depth = 0").groupBy("corpus").agg(F.count("*").alias("n")).collect()} == {"Brand1": 1, "std": 1}
    ids = [r["node_id"] for r in nodes.where("tag = 'clause'").orderBy("corpus", "pre").collect()]
    assert ids == [f"_c{k}" for k in range(400)] + sorted((f"_hx{h}" for h in range(400)), key=lambda i: f'<part num="9.{int(i[3:]) % 60}" id="_hp{i[3:]}"')


def test_collapse_takes_every_white_space(spark):
    rows = [chr(c) for c in range(1, 0x3101) if not 0xD800 <= c < 0xE000] + [" ", "  ", " \t", "\t ", "\u00a0 \u00a0", "\u3000\n\x1c", "x  "]
    made = spark.createDataFrame([(n, f"a{x}b {x} c{x}") for n, x in enumerate(rows)], "n int, x string")
    plain = F.trim(F.regexp_replace("x", f"{WHITESPACE}+", " "))
    assert made.where(collapse("x") != plain).count() == 0
    assert [r[0] for r in made.where(f"n >= {len(rows) - 7}").orderBy("n").select(collapse("x")).collect()] == ["a b c"] * 6 + ["ax b x cx"]


CONTENTS = """<volume publishing-id="m">
<part id="_p1"><title>T</title><intro-part><content/><content><p>Second.</p></content></intro-part></part>
<part id="_p2"><title>Fallback</title></part>
<clause id="_c1"><sptc>A</sptc><title>T</title><content><num>3</num><section><title>Outer</title><section><title>Inner</title><title>No</title>
<p>Has <equation-inline><mi>x</mi></equation-inline> in.</p></section><equation-block/></section>
<ul class="numbered"><li>one<p>apart</p><ul><li>two <b>bold</b> tail</li></ul>after</li></ul><p>  </p></content></clause>
<clause id="_c2"><sptc>B</sptc><title>T</title><content><p>x<content><p>within</p></content>y</p></content><content><p>not this</p></content></clause>
<glossentry id="_g"><glossterm>t</glossterm><glossdef><content><p>a</p></content><content> </content><content><num>2 </num><p>b</p></content></glossdef></glossentry>
</volume>"""


def test_texts_are_put_together_where_their_pieces_meet(spark):
    """Every kind of line, empty and nested blocks; texts move to their owner once."""
    corpora = spark.createDataFrame([("m", "M", 0)], "corpus string, doc_label string, corpus_ord int")
    nodes = stored(parse_documents(spark.createDataFrame([("m", CONTENTS)], "corpus string, content string"), corpora))
    images = spark.createDataFrame([], "corpus string, filename string")
    built = build_chunks(nodes, images)
    assert {r["id"]: r["text"] for r in built.collect()} == {
        "p1": "", "p2": "Fallback",
        "c1": "3 Outer:\nInner:\nHas x in.\n[equation]\n(1) oneapartafter\n  (i) two bold tail", "c2": "xwithiny", "g": "a\n2 b",
    }
    plan = content_texts(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("REPARTITION_BY_COL")[0].count("Exchange") == 1  # nothing moves after the pieces


def test_stored_tables_leave_no_shuffle_files(spark):
    """What the making of a stored table shuffled is gone once it is written."""
    context = spark.sparkContext._jsc.sc()
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    table = stored(spark.range(2000).repartition(3, "id").groupBy("id").count())
    assert table.count() == 2000 and context is not None
    assert tracker.shuffleStatuses().size() <= before + 1  # the count's own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_lists_are_gathered_for_the_chunks_asked_for(spark):
    """Edges without a target do not meet under one key, nor are they put into lists of
    chunks that are not there."""
    corpora = spark.createDataFrame([("m", "M", 0)], "corpus string, doc_label string, corpus_ord int")
    nodes = stored(parse_documents(spark.createDataFrame([("m", NESTED)], "corpus string, content string"), corpora))
    images = spark.createDataFrame([], "corpus string, filename string")
    chunks = stored(build_chunks(nodes, images))
    edges = build_references(nodes, chunks, images, "m")
    plan = edges._jdf.queryExecution().optimizedPlan().toString().split("Project")
    assert any("Join LeftOuter" in part and "_guid" in part for part in plan)
    nested = nest_references(chunks.where("id = 'v'"), edges)
    assert [(r["id"], r["cross_refs"], [x["chunk_id"] for x in r["internal_refs"]]) for r in nested.collect()] == [("v", ["two"], ["s"])]
    assert "LeftSemi" in nested._jdf.queryExecution().optimizedPlan().toString()
