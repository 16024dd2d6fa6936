"""Inputs on which data was once lost or misplaced."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpuskit.functions import captions, citations
from corpuskit.functions.text import figure_number_from_heading
from corpuskit.operators import filters, glossary
from corpuskit.plans.compliance import findings
from corpuskit.plans.hybrid import hybrid_hits
from corpuskit.sources import files
from corpuskit.sources.structured import Corpus, corpora_table, scan_documents

BLANKS = (" ", "\u00a0", "\u2009", "\u3000")


def test_unicode_blanks_in_patterns(spark):
    for blank in BLANKS:
        text = f"See AS{blank}1684.2{blank}Part{blank}3 and NSW{blank}Part{blank}9.6{blank}of the Housing Provisions."
        row = spark.createDataFrame([(text,)], "t string").select(
            citations.standard_mentions("t").alias("s"), citations.prose_citations("t").alias("p")
        ).first()
        assert row["s"] == ["AS 1684.2 Part 3"]
        assert [(c["label"], c["number"], c["display"]) for c in row["p"]] == [("part", "9.6", "Part 9.6")]
        caption = f"{blank}Figure{blank}3.2{blank}(note){blank}:{blank}A wall"
        parts = spark.createDataFrame([(caption, f"Figure{blank}7.1a Walls")], "t string, h string").select(
            captions.caption_parts("t").alias("c"), figure_number_from_heading("h").alias("n")
        ).first()
        assert (parts["c"]["kind"], parts["c"]["number"], parts["c"]["qualifier"], parts["c"]["title"], parts["n"]) == ("Figure", "3.2", "note", "A wall", "7.1a")
    none = spark.createDataFrame([("plain text",), ("",), (None,)], "t string").select(captions.caption_parts("t").alias("c")).collect()
    assert all(set(r["c"]) == {""} for r in none)


def _chunks(path, *rows):
    path.write_text(json.dumps([{"id": i, "node_type": "clause", "text": t} for i, t in rows]))


def test_later_files_come_later_however_they_are_spelled(spark, tmp_path):
    odd = tmp_path / "a folder+%20x"
    odd.mkdir()
    _chunks(odd / "b.json", ("1", "first" * 400))
    _chunks(odd / "a b.json", ("1", "second"))
    spellings = [
        [str(odd / "b.json"), str(odd / "a b.json")],
        [f"file://{odd}/b.json".replace("%", "%25"), str(odd / "a b.json")],
        [str(odd) + "//b.json", str(odd) + "/a b.json"],
    ]
    for paths in (spellings[0], spellings[2]):
        got = {r["text"][:6]: r["file_ord"] for r in files.read_chunks(spark, paths).collect()}
        assert got == {"firstf": 0, "second": 1}
    plain = tmp_path / "plain"
    plain.mkdir()
    _chunks(plain / "z.json", ("1", "under the folder"))
    _chunks(tmp_path / "y.json", ("1", "after it"))
    for paths in ([str(plain), str(tmp_path / "y.json")], [f"file://{plain}/", f"file:{tmp_path}/y.json"]):
        assert {r["text"]: r["file_ord"] for r in files.read_chunks(spark, paths).collect()} == {"under the folder": 0, "after it": 1}
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"image": "a.png", "description": "x"}\n')
    schema = spark.createDataFrame([], "image string, description string").schema
    assert files.read_jsonl(spark, [str(plain), f"file://{lines}"][1:], schema, ["image"]).first()["line"]["file"] == 0


def test_suffixes_in_any_case(spark, tmp_path):
    for name in ("a.png", "b.PNG", "c.Png", "d.txt", "png"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["name"] for r in files.find_files(spark, [f"file://{tmp_path}"], [".png"]).collect()) == ["a.png", "b.PNG", "c.Png"]


def test_a_corpus_without_a_file_fails(spark, tmp_path):
    (tmp_path / "one.xml").write_text("<a/>")
    there = Corpus("one", "One", f"file://{tmp_path}/one.xml")
    lost = Corpus("two", "Two", str(tmp_path / "two.xml"))
    assert scan_documents(spark, corpora_table(spark, [there]), [str(tmp_path)]).count() == 1
    with pytest.raises(PySparkException, match="no file was read for corpus two"):
        scan_documents(spark, corpora_table(spark, [there, lost]), [str(tmp_path)]).collect()


def test_several_classifications_of_a_clause(spark):
    required = spark.createDataFrame([(1, "A", "d", "h"), (1, "B", "d", "h")], "query_id int, clause_id string, doc string, heading string")
    judged = spark.createDataFrame([(1, "A", "addressed", "x", "e", 1), (1, "A", "missing", "y", "e", 2)], "query_id int, clause_id string, status string, explanation string, evidence string, n int")
    got = {r["clause_id"]: r["status"] for r in findings(required, judged, order="n").collect()}
    assert got == {"A": "missing", "B": "needs_review"}
    with pytest.raises(PySparkException, match="several rows for key"):
        findings(required, judged).collect()


def test_jurisdictions_are_checked_in_the_search(spark):
    chunks = spark.createDataFrame(
        [(1, "clause", None, "h", "timber walls", [1.0, 0.0]), (2, "clause", ["NSW"], "h", "timber walls", [0.9, 0.1])],
        "id long, node_type string, jurisdictions array<string>, heading string, text string, embedding array<float>",
    )
    for asked, found in (("NSW", {1, 2}), ("nsw", {1, 2}), ("VIC", {1}), (None, {1, 2})):
        q = spark.createDataFrame([(7, "timber", [1.0, 0.0], asked)], "query_id long, query_text string, qvec array<float>, jurisdiction string")
        assert {r["id"] for r in hybrid_hits(chunks, q).collect()} == found
    q = spark.createDataFrame([(7, "timber", [1.0, 0.0], "XX")], "query_id long, query_text string, qvec array<float>, jurisdiction string")
    with pytest.raises(PySparkException, match="no such jurisdiction"):
        hybrid_hits(chunks, q).collect()


def test_terms_without_words(spark):
    questions = spark.createDataFrame([(1, "what is -> and FRL?"), (2, "nothing here"), (3, "use §§ now")], "query_id int, question string")
    terms = spark.createDataFrame([("->", 1), ("FRL", 2), ("§§", 3), ("§x", 4)], "term string, gid int")
    assert sorted((r["query_id"], r["term"]) for r in glossary.terms_in_questions(questions, terms).collect()) == [(1, "->"), (1, "FRL"), (3, "§§")]


def test_openings_of_any_length(spark):
    texts = spark.createDataFrame(
        [(1, "An Inner  wall stands, as the outer wall would."), (2, "prewired cables"), (3, ""), (4, None), (5, "x y")], "query_id int, answer string"
    )
    items = spark.createDataFrame(
        [(1, "inner WALL"), (2, "wired"), (3, "inner wall stands"), (4, "the outer wall would"), (5, ""), (6, None), (7, "y"), (8, "absent words here now"), (9, "ner wall st")],
        "item_id int, text string",
    )
    got = {(r["query_id"], r["item_id"]) for r in glossary.quoted_openings(texts, items).collect()}
    plain = {(q, i) for q, a in [(1, "an inner wall stands, as the outer wall would."), (2, "prewired cables"), (5, "x y")]
             for i, t in [(1, "inner wall"), (2, "wired"), (3, "inner wall stands"), (4, "the outer wall would"), (7, "y"), (8, "absent words here now"), (9, "ner wall st")] if t in a}
    assert got == plain
    assert {(r["query_id"], r["item_id"]) for r in glossary.quoted_openings(texts, items.where("item_id IN (3, 4)")).collect()} == {(1, 3), (1, 4)}


def test_visibility_without_jurisdictions(spark):
    rows = spark.createDataFrame([(1, None), (2, ["NSW"]), (3, [])], "id int, j array<string>")
    seen = lambda a: {r["id"] for r in rows.where(filters.in_jurisdiction("j", F.lit(a).cast("string"))).collect()}
    assert (seen(None), seen("NSW"), seen("SA")) == ({1, 2, 3}, {1, 2}, {1})


def test_sources_go_with_findings_and_citations(spark):
    from corpuskit.plans.answers import audit_answers, build_requirements

    hits = spark.createDataFrame(
        [(1, 1, "A1", "doc", "subclause", "A1 Walls", "Walls stand.", "http://x/a1", ["2"], None, [3], None)],
        "query_id int, rank int, clause_id string, doc string, node_type string, heading string, text string, source_url string, "
        "building_classes array<string>, jurisdictions array<string>, climate_zones array<int>, applicability_note string",
    )
    answers = spark.createDataFrame([(1, "A wall is a thing that stands.")], "query_id int, answer string")
    terms = spark.createDataFrame([(1, "wall", "a wall is a thing", 1)], "query_id int, term string, definition string, ord int")
    cited = {r["source"]: r for r in audit_answers(answers, hits, terms)[1].collect()}
    assert (cited["chunk"]["source_url"], cited["chunk"]["heading"], cited["chunk"]["climate_zones"]) == ("http://x/a1", "A1 Walls", [3])
    assert cited["definition"]["source_url"] is None and cited["definition"]["clause_id"] == "wall"
    judged = spark.createDataFrame([(1, "A1", "addressed", "x", "e")], "query_id int, clause_id string, status string, explanation string, evidence string")
    assert findings(hits, judged).first()["source_url"] == "http://x/a1"
    documents = spark.createDataFrame([(1, "Our walls."), (2, "No hits.")], "query_id int, document_text string")
    prompts = build_requirements(documents, hits, terms).collect()
    assert [p["query_id"] for p in prompts] == [1]
    places = [prompts[0]["prompt"].index(x) for x in ("REQUIREMENTS:", "A1", "Walls stand.", "DEFINITIONS:", "wall", "DOCUMENT:", "Our walls.")]
    assert places[0] < places[1] < places[2] < places[3] < places[5] < places[6]


def test_stems_of_lists(spark):
    from corpuskit.functions.porter2 import stem, stem_batch

    rows = [(["running", None, "walls"],), ([],), (None,), (["running", "consistency"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(stem_batch("t")).collect()]
    assert got == [[stem("running"), None, stem("walls")], [], None, [stem("running"), stem("consistency")]]


def test_a_trial_run_embeds_the_first_ids(spark):
    from corpuskit.operators.scorers import hashed_embedding
    from corpuskit.plans.embed import embed_new

    chunks = spark.createDataFrame([(i, f"text {i}", None) for i in (5, 3, 9, 1)] + [(0, " ", None)], "id int, text string, heading string")
    got = embed_new(chunks, [], hashed_embedding(4), "m", 4, limit=2)
    assert sorted(r["id"] for r in got.collect()) == [1, 3]


def test_description_store_is_written_in_bounded_files(spark, tmp_path, monkeypatch):
    """Each file of the store holds few keys, and the descriptions stay the same."""
    from workload import file_queries

    spark.range(1, 3001).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "CAST(id % 50 + 1 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 11).selectExpr("id AS s_suppkey", "concat('supplier ', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    folders, make = [], file_queries._folder
    monkeypatch.setattr(file_queries, "_folder", lambda *a: folders.append(make(*a)) or folders[-1])
    got = {r.id: r.description for r in file_queries.description_files(spark, str(tmp_path)).collect()}
    lines = spark.read.option("recursiveFileLookup", True).text(folders[1]).groupBy("_metadata.file_path").count().collect()
    assert len(lines) == 6 and max(r["count"] for r in lines) <= file_queries.PER_FILE
    kept = [i for i in range(1, 3001) if (i % 50 + 1) % 7]
    for f in range(20, 1500, 2):
        own = [i for i in kept if i // 2 == f]
        text = f"part {own[-1]}" + ("" if own[-1] % 50 + 1 > 45 else "!") if own else None
        assert got[f] == text
