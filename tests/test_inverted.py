"""The stored index against the scan over all documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuskit.functions.analyzer import english, simple
from corpuskit.operators import inverted
from corpuskit.operators.lexical import lexical_top_k, matches
from corpuskit.plans.hybrid import hybrid_hits

CHUNK = "id long, node_type string, jurisdictions array<string>, heading string, text string, embedding array<double>"
QUERY = "query_id long, query_text string, qvec array<double>, jurisdiction string"


def corpus(spark, rows=400, seed=1):
    rng = random.Random(seed)
    words = [f"word{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)] + ["running", "runner", "the", "flies"] * 40
    body = []
    for i in range(rows):
        text = None if i % 90 == 7 else " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        body.append((i, rng.choice(["part", "part", "glossary"]), rng.choice([None, ["NSW"], ["VIC", "NSW"], []]), rng.choice([None, "A word1 heading"]), text, [rng.random(), 1.0]))
    return spark.createDataFrame(body, CHUNK)


def asked(spark, n=60, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"word{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(4))), [1.0, rng.random()], rng.choice([None, None, "NSW", "VIC"])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, "runs fly", [1.0, 0.0], None), (n + 1, "nowhere", None, None), (n + 2, None, None, None), (n + 3, "word1 word1", None, "QLD")], QUERY)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("analyzer", [simple, english])
@pytest.mark.parametrize("tokens, documents", [(1 << 20, 1 << 13), (900, 1 << 13), (1 << 20, 7)])
def test_equal_to_a_scan(spark, analyzer, tokens, documents):
    chunks, queries = corpus(spark).repartition(3), asked(spark)
    index = inverted.build(chunks, analyzer, block_tokens=tokens, block_documents=documents)
    assert rows(inverted.matches(index, queries), "query_id", "id", "score") == rows(matches(chunks, queries, analyzer), "query_id", "id", "score")
    assert rows(inverted.top_k(index, queries, 3), "query_id", "rank", "id", "score") == rows(lexical_top_k(chunks, queries, 3, analyzer), "query_id", "rank", "id", "score")


def test_only_the_folders_of_asked_terms_are_read(spark):
    index = inverted.build(corpus(spark), buckets=16)
    query = spark.createDataFrame([(1, "word3", None, None)], QUERY)
    found = inverted.matches(index, query)
    plan = found._jdf.queryExecution().executedPlan().toString()
    [folder] = [r[0] for r in spark.range(1).select(inverted.bucket_of(F.lit("word3"), 16)).collect()]
    filters = [f for f in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if f]
    assert filters and all(f"= {folder})" in f or f"({folder})" in f or "= -1)" in f for f in filters), filters


def test_blocks_under_the_kth_score_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(inverted, "FIRST_BLOCKS", 2)
    body = [(i, "part", None, None, "alpha beta " * (40 if i < 20 else 1), None) for i in range(400)]
    chunks = spark.createDataFrame(body, CHUNK).coalesce(1)
    index = inverted.build(chunks, block_documents=10)
    assert index.blocks == 40
    query = spark.createDataFrame([(1, "alpha beta", None, None)], QUERY)
    seen = []
    scored = inverted._scored
    monkeypatch.setattr(inverted, "_scored", lambda *a: (seen.append(a[3].count()), scored(*a))[1])
    best = inverted.top_k(index, query, 5)
    assert [r["id"] for r in best.orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert seen == [2, 0]  # two blocks of high bound, and none of the other 38


def test_many_queries_meet_a_block_in_slots(spark, monkeypatch):
    monkeypatch.setattr(inverted, "SLOT_QUERIES", 10)
    chunks, queries = corpus(spark), asked(spark)
    index = inverted.build(chunks, block_documents=50)
    assert rows(inverted.top_k(index, queries, 4), "query_id", "rank", "id") == rows(lexical_top_k(chunks, queries, 4), "query_id", "rank", "id")


def test_hybrid_search_by_index(spark):
    chunks, queries = corpus(spark), asked(spark)
    index = inverted.build(chunks)
    options = {"jurisdictions": ["NSW", "VIC", "QLD"]}
    assert rows(hybrid_hits(chunks, queries, index=index, **options), "query_id", "rank", "id") == rows(hybrid_hits(chunks, queries, **options), "query_id", "rank", "id")


def test_an_index_of_nothing(spark):
    index = inverted.build(spark.createDataFrame([], CHUNK))
    assert index.blocks == 0 and inverted.top_k(index, asked(spark), 3).count() == 0


def test_texts_move_for_their_vectors_only_where_those_repeat(spark, tmp_path):
    from workload.tables import chunks, text_chunks

    rows = [(1, "Heat\nin halls", "en", "s", 13), (2, "Cold", "de", "s", 4), (None, "Nobody", "en", "s", 6)]
    for name, ids in (("once", [1, 5, None, None]), ("twice", [1, 1, 2, None])):
        sf = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, [1.0]) for i in ids], "vec_id long, embedding array<float>").write.parquet(f"{sf}/embeddings.parquet")
        found = text_chunks(spark, sf)
        assert sorted(map(str, found.collect())) == sorted(map(str, chunks(spark, sf).drop("embedding").collect()))
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == (name == "twice")
