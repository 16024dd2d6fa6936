"""Sources, sinks, loading, merging, embedding, review, ranking."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpuskit.operators import merge, quality, review
from corpuskit.operators.conversations import answered_pairs, recent_history
from corpuskit.operators.glossary import definitions_for
from corpuskit.operators.ranking import best_rows, ordered_positions
from corpuskit.operators.scorers import batch_embedding, guarded, hashed_embedding, split_results
from corpuskit.plans.backfill import backfill_descriptions
from corpuskit.plans.embed import embed_new, merge_vectors, to_embed
from corpuskit.plans.load import load_corpus
from corpuskit.schemas import DESCRIPTION, VECTOR_LOG
from corpuskit.sinks import tables
from corpuskit.sources import files


def test_ordered_positions_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", i) for i in rng.sample(range(10_000), 600)] + [(f"g{i % 5}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "grp string, k int")
    got = {(r["grp"], r["k"]): r["position"] for r in ordered_positions(df, ["grp"], "k", pieces=8).collect()}
    for grp in {g for g, _ in rows}:
        keys = sorted(k for g, k in rows if g == grp)
        assert [got[(grp, k)] for k in keys] == list(range(1, len(keys) + 1))


def greedy_deal(items, pinned, groups):
    """The rule as a loop: each free item goes to the group furthest below its share."""
    out = dict(pinned)
    for corpus in sorted(set(items.values())):
        keys = sorted(k for k, c in items.items() if c == corpus)
        share = {g: len(keys) // len(groups) + (i < len(keys) % len(groups)) for i, g in enumerate(groups)}
        need = {g: share[g] - sum(pinned.get(k) == g for k in keys) for g in groups}
        for key in keys:
            if key not in pinned:
                g = max(groups, key=lambda x: (need[x], -groups.index(x)))
                out[key] = g
                need[g] -= 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_deal_equals_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    items = {f"k{i:03d}": rng.choice(["x", "y"]) for i in range(rng.randint(1, 60))}
    pinned = {k: rng.choice("aab") for k in items if rng.random() < 0.4}
    got = review.deal(
        spark.createDataFrame(list(items.items()), "key string, corpus string"),
        spark.createDataFrame(list(pinned.items()), "key string, grp string"),
    )
    assert {r["key"]: r["grp"] for r in got.collect()} == greedy_deal(items, pinned, "abc")


def test_publish_replaces_the_table_it_reads(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.read_table(spark, root) is None
    tables.publish(spark.range(3), root)
    tables.publish(merge.upsert(tables.read_table(spark, root), spark.range(2, 5)), root)
    assert sorted(r["id"] for r in tables.read_table(spark, root).collect()) == [0, 1, 2, 3, 4]
    assert len(tables.remove_old_versions(spark, root)) == 1 and tables.remove_old_versions(spark, root) == []
    assert tables.read_table(spark, root).count() == 5


def _record(**values):
    return {"id": "1", "doc": "D", "text": "t", **values}


def test_load(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps([_record(jurisdictions=[], text=None), _record(id="2", building_classes=["2"], embedding=[1.0, 2.0])]))
    b.write_text(json.dumps([_record(heading="late", external_refs=[{"kind": "standard", "standard": "AS 1"}])]))
    root = str(tmp_path / "table")
    records = files.read_chunks(spark, [str(a), str(b)])
    dry = load_corpus(spark, records, root, "v1", dry_run=True).first().asDict()
    assert dry == {"records_read": 3, "rows_to_write": 2, "figures_with_refs": 0, "rows_with_embedding": 1, "duplicates_collapsed": 1}
    assert tables.read_table(spark, root) is None
    load_corpus(spark, records, root, "v1")
    load_corpus(spark, records, root, "v1")
    rows = {r["id"]: r for r in tables.read_table(spark, root).collect()}
    assert len(rows) == 2
    one, two = rows["1"], rows["2"]
    assert one["heading"] == "late" and one["node_type"] == "clause" and one["jurisdictions"] is None
    assert one["standard_refs"][0]["standard"] == "AS 1" and one["hierarchy"] == [] and two["building_classes"] == ["2"]


def test_bad_chunk_files_fail(spark, tmp_path):
    broken = tmp_path / "x.json"
    broken.write_text('[{"id": "1", ')
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD"):
        files.read_chunks(spark, [str(broken)]).collect()
    with pytest.raises(PySparkException):
        files.read_chunks(spark, [str(tmp_path / "missing.json")]).collect()
    other = tmp_path / "y.json"
    other.write_text('{"a": 1}')
    with pytest.raises((PySparkException, Py4JJavaError), match="needs an id"):
        files.read_chunks(spark, [str(other)]).collect()


def test_description_stores(spark, tmp_path):
    first, second = tmp_path / "a.jsonl", tmp_path / "b.json"
    lines = [{"image": "d/f1.png", "description": "one"}, {"image": "f1.png", "description": "two"}, {"image": "f3.png"}, {"image": "f4.svg", "description": ""}]
    first.write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    second.write_text(json.dumps({"f2.svg": "flat", "f5.svg": 7, "f6.svg": "  ", "f1.svg": "svg"}))
    jsonl = files.read_jsonl(spark, [str(first)], DESCRIPTION, ["image", "description"])
    flat = files.read_flat_index(spark, [str(second)])
    assert {r["image"] for r in flat.collect()} == {"f2.svg", "f1.svg"}
    added = files.description_additions(jsonl, flat)
    wanted = spark.createDataFrame([("f1.svg",), ("f1.png",), ("f1.gif",), ("f2.svg",), ("f9.svg",)], "src string")
    got = {r["src"]: r["description"] for r in files.describe(wanted, "src", added).collect()}
    assert got == {"f1.svg": "svg", "f1.png": "two", "f1.gif": "one", "f2.svg": "flat", "f9.svg": None}


def test_vector_log_keeps_the_last_line(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"id": "a", "embedding": [1.0]}\n{"id": "b"}\n{"id": "a", "embedding": [2.0]}\n{bad\n')
    rows = files.read_jsonl(spark, [str(log)], VECTOR_LOG, ["id", "embedding"])
    assert [(r["id"], r["embedding"]) for r in best_rows(rows, ["id"], F.col("line"), "last").collect()] == [("a", [2.0])]


def test_files_and_review_state(spark, tmp_path):
    (tmp_path / "img" / "deep").mkdir(parents=True)
    for name in ("img/a.PNG", "img/deep/b.svg", "img/c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.find_files(spark, [str(tmp_path / "img")], [".png", ".svg"])
    assert sorted(r["label"] for r in found.collect()) == ["a.PNG", "deep/b.svg"]
    (tmp_path / "group-a.json").write_text(json.dumps({"results": {"k1": {"verdict": "correct"}, "k2": {"verdict": ""}, "zz": {"verdict": "correct"}}}))
    (tmp_path / "group-q.json").write_text(json.dumps({"results": {"k1": {"verdict": "incorrect"}}}))
    (tmp_path / "group-b.json").write_text("{broken")
    keys = spark.createDataFrame([("k1",), ("k2",)], "key string")
    state = files.read_review_state(spark, str(tmp_path), ["a", "b", "c"], keys)
    assert [tuple(r) for r in state.collect()] == [("k1", "a", "correct")]


def test_embedding_resumes_and_guards(spark):
    chunks = spark.createDataFrame([("a", "x y", None), ("b", " ", None), ("c", "z", "H")], "id string, text string, heading string")
    model = hashed_embedding(8)
    first = embed_new(chunks.where("id = 'a'"), [], model, "m", 8).cache()
    assert {r["id"] for r in to_embed(chunks, [first]).collect()} == {"c"}
    second = embed_new(chunks, [first], model, "m", 8)
    assert [r["id"] for r in second.collect()] == ["c"]
    assert embed_new(chunks, [first, second], model, "m", 8).count() == 0
    assert merge_vectors(chunks, first).where("embedding IS NULL").count() == 2
    with pytest.raises(ValueError, match="do not match"):
        embed_new(chunks, [first], model, "other", 8)
    with pytest.raises(PySparkException, match="must return 9 values"):
        embed_new(chunks, [], model, "m", 9).collect()
    with pytest.raises(PySparkException, match="got 0"):
        embed_new(chunks, [], batch_embedding(lambda: lambda texts: []), "m", 8).collect()


def test_failed_rows_carry_on(spark):
    def load():
        def model(text):
            if text == "bad":
                raise ValueError("no")
            return text.upper()

        return model

    df = spark.createDataFrame([("ok",), ("bad",)], "t string").withColumn("r", guarded(load, attempts=2)(F.col("t")))
    good, bad = split_results(df, "r")
    assert [r["r"]["value"] for r in good.collect()] == ["OK"]
    assert [(r["r"]["error"], r["r"]["attempts"]) for r in bad.collect()] == [("ValueError: no", 2)]


def test_backfill_and_repair(spark):
    chunks = spark.createDataFrame(
        [("1", "figure", "D", "Figure 1.2a: Wall", "Wall"), ("2", "figure", "D", "Figure 9: X", "X"), ("3", "table", "D", "Figure 1.2a", "t"),
         ("4", "figure", "D", "Figure 3: Z", "Z\n\n## Description")],
        "id string, node_type string, doc string, heading string, text string",
    )
    descriptions = spark.createDataFrame([("D", "1.2a", "Drawn."), ("D", "3", "d")], "doc string, number string, description string")
    updated, ids = backfill_descriptions(chunks, descriptions)
    assert [r["id"] for r in ids.collect()] == ["1"]
    assert updated.where("id = '1'").first()["text"] == "Figure 1.2a: Wall\n\nDrawn."
    stored = spark.createDataFrame([("1", "ab"), ("2", "xx"), ("3", "same")], "id string, text string")
    fresh = spark.createDataFrame([("1", "abc"), ("2", "yy"), ("3", "same")], "id string, text string")
    repaired, backup, changes = merge.repair_truncated(stored, fresh)
    assert [tuple(r) for r in backup.collect()] == [("1", "ab")]
    assert {r["id"]: r["text"] for r in repaired.collect()} == {"1": "abc", "2": "xx", "3": "same"}
    merge.require_changes(changes, 1)
    with pytest.raises(RuntimeError):
        merge.require_changes(changes, 2)
    twice = spark.createDataFrame([("1", "abc"), ("1", "abd")], "id string, text string")
    with pytest.raises(Exception, match="several rows for key"):
        merge.repair_truncated(stored, twice)[0].collect()


def test_several_changes_of_a_row(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, None, 0)], "id int, text string, at int")
    last = merge.update_columns(target, changes, ["text"], order="at")
    assert sorted(tuple(r) for r in last.collect()) == [(1, "y"), (2, "b")]
    with pytest.raises(Exception, match="several rows for key"):
        merge.update_columns(target, changes, ["text"]).collect()


def test_queue_modes(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    run = lambda mode: sorted(r["id"] for r in merge.queue(ids(1, 2, 3), ids(1), ids(1, 2), mode).collect())
    assert (run("new"), run("retry"), run("overwrite"), run("overwrite-retry")) == ([2, 3], [2], [1, 2, 3], [1, 2])


def test_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "" if t == 5 else f"m{t}", t == 3) for t in range(9)]
    m = spark.createDataFrame(rows, "conversation_id int, turn int, role string, text string, is_error boolean")
    assert [r["turn"] for r in recent_history(m).orderBy("turn").collect()] == [3, 4, 6, 7, 8]
    assert sorted((r["question"], r["answer"]) for r in answered_pairs(m).collect()) == [("m0", "m1"), ("m4", ""), ("m6", "m7")]


def test_definitions(spark):
    glossary = spark.createDataFrame(
        [("Habitable room", "A room.", 1), ("FRL", "Level.", 2), ("room", "Space.", 3), ("C", "Letter.", 4), ("AS", "Standard.", 5), ("none", "", 6)],
        "term string, definition string, gid int",
    )
    questions = spark.createDataFrame([(1, "Is a HABITABLE ROOM as wide as FRL in C?"), (2, "mushroom")], "query_id int, question string")
    hits = spark.createDataFrame([(1, 1, ["room", "AS", "nope", "none"]), (2, 1, ["AS", "AS"])], "query_id int, rank int, defined_terms array<string>")
    got = definitions_for(hits, questions, glossary).orderBy("query_id", "ord").collect()
    assert [(r["query_id"], r["term"]) for r in got] == [(1, "Habitable room"), (1, "room"), (1, "FRL"), (1, "AS"), (2, "AS")]
    assert definitions_for(hits, questions, glossary, cap=2).where("query_id = 1").count() == 2


def test_rules(spark):
    df = spark.createDataFrame([(1, "incorrect", " "), (2, "correct", None), (3, "odd", "x")], "id int, verdict string, why string")
    rules = [quality.one_of("verdict", "correct", "incorrect"), quality.explained_when("verdict", "incorrect", "why")]
    assert sorted(map(tuple, quality.violations(df, "id", rules).collect())) == [(1, "verdict_explained"), (3, "verdict_allowed")]
    assert quality.enforce(df.where("id = 2"), rules).count() == 1
    with pytest.raises(PySparkException, match="rule broken"):
        quality.enforce(df, rules).collect()


def test_feedback_rows(spark):
    flags = spark.createDataFrame([("A1", "q", "missing")], "clause_id string, query string, reported_status string")
    row = tables.feedback_rows(flags).first()
    assert len(row["id"]) == 36 and row["comment"] is None and row["created_at"] is not None
