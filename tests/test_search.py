"""Search operators against brute force, and the filters around them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpuskit import sizing
from corpuskit.functions.analyzer import english, query_terms
from corpuskit.functions.porter2 import stem
from corpuskit.operators import filters
from corpuskit.operators.dense import approximate_top_k, dense_top_k, hyperplanes, with_cells
from corpuskit.operators.fusion import rerank
from corpuskit.operators.lexical import lexical_top_k, matches
from corpuskit.operators.scorers import batch_pair_scorer, token_overlap
from corpuskit.plans.hybrid import hybrid_search

WORDS = ["wall", "roof", "fire", "door", "stair"]
CHUNK = "id long, node_type string, jurisdictions array<string>, heading string, text string, embedding array<float>"
QUERY = "query_id long, query_text string, qvec array<float>, jurisdiction string"


def brute_covers(tokens, terms, k=16):
    """Minimal covers by definition: spans holding every term, none of which holds another."""
    spans = []
    for i, j in itertools.combinations_with_replacement(range(len(tokens)), 2):
        if set(terms) <= set(tokens[i : j + 1]):
            spans.append((i, j))
    minimal = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sum(min(1.0, k / (j - i + 1)) for i, j in minimal)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows, queries = [], []
    for i in range(80):
        tokens = [rng.choice(WORDS + ["x"]) for _ in range(rng.randint(1, 24))]
        where = rng.choice([None, ["NSW"], ["VIC", "NSW"], ["QLD"]])
        vec = None if i % 5 == 0 else [rng.gauss(0, 1) for _ in range(4)]
        rows.append((i, "glossary" if i % 11 == 0 else "subclause", where, tokens[0], " ".join(tokens[1:]), vec))
    for q in range(12):
        text = "" if q == 7 else " ".join(rng.sample(WORDS, rng.randint(1, 3)))
        queries.append((q, text, None if q == 5 else [rng.gauss(0, 1) for _ in range(4)], rng.choice([None, "NSW", "VIC"])))
    return rows, queries, spark.createDataFrame(rows, CHUNK), spark.createDataFrame(queries, QUERY)


def open_to(row, query):
    return row[1] != "glossary" and (query[3] is None or row[2] is None or query[3] in row[2])


def test_cover_density_equals_brute_force(corpus):
    rows, queries, chunks, asked = corpus
    got = {(r["query_id"], r["id"]): r["score"] for r in matches(chunks, asked).collect()}
    want = {}
    for q, r in itertools.product(queries, rows):
        terms, tokens = q[1].split(), (r[3] + " " + r[4]).split()
        if terms and set(terms) <= set(tokens) and open_to(r, q):
            want[(q[0], r[0])] = round(brute_covers(tokens, terms), 6)
    assert got == pytest.approx(want)


def test_top_k_equals_global_order(corpus):
    rows, queries, chunks, asked = corpus
    got = [(r["query_id"], r["id"], r["rank"]) for r in dense_top_k(chunks.repartition(7), asked, 5).collect()]
    want = []
    for q in queries:
        if q[2] is None:
            continue
        scored = []
        for r in rows:
            if r[5] is not None and open_to(r, q):
                a, b = np.float32(r[5]).astype(float), np.float32(q[2]).astype(float)
                scored.append((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 6), r[0]))
        want += [(q[0], i, n + 1) for n, (_, i) in enumerate(sorted(scored)[:5])]
    assert sorted(got) == sorted(want)


def test_blocks_of_a_large_batch_give_the_same_hits(corpus):
    _, _, chunks, asked = corpus
    whole = sorted(map(tuple, lexical_top_k(chunks, asked, 3).collect()))
    near = sorted(map(tuple, dense_top_k(chunks, asked, 3).collect()))
    small = sizing.store_queries(asked.withColumn("terms", query_terms("query_text")), block_rows=2)
    plan = lexical_top_k(chunks, small, 3)
    assert sorted(map(tuple, plan.collect())) == whole
    assert sorted(map(tuple, dense_top_k(chunks, small, 3).collect())) == near
    # One pass over the corpus whatever the number of blocks.
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_no_queries(corpus):
    _, _, chunks, asked = corpus
    assert hybrid_search(chunks, asked.where("false")).collect() == []


def test_jurisdiction_filter_is_monotone(corpus):
    _, _, chunks, asked = corpus
    free = {(r["query_id"], r["id"]) for r in matches(chunks, asked.withColumn("jurisdiction", F.lit(None).cast("string"))).collect()}
    some = {(r["query_id"], r["id"]) for r in matches(chunks, asked).collect()}
    assert some <= free


def test_hybrid_and_rerank(corpus):
    _, _, chunks, asked = corpus
    hits = hybrid_search(chunks, asked, top=6, payload=["node_type", "text"])
    assert hits.where("node_type = 'glossary'").count() == 0
    scorer = batch_pair_scorer(lambda: lambda pairs: [float(len(p)) for _, p in pairs])
    top = rerank(hits, asked, 2, scorer).collect()
    assert {r["rerank_rank"] for r in top} <= {1, 2}
    with pytest.raises(PySparkException, match="0 scores came back"):
        rerank(hits, asked, 2, batch_pair_scorer(lambda: lambda pairs: [])).collect()


def test_approximate_scores_are_exact(corpus):
    _, _, chunks, asked = corpus
    planes = hyperplanes(4, 3)
    near = {(r["query_id"], r["id"]): r["distance"] for r in approximate_top_k(with_cells(chunks, planes), asked, planes, 5).collect()}
    exact = {(r["query_id"], r["id"]): r["distance"] for r in dense_top_k(chunks, asked, 80).collect()}
    assert near and all(exact[k] == v for k, v in near.items())
    everything = approximate_top_k(with_cells(chunks, planes), asked, planes, 5, flips=3).count()
    assert everything == dense_top_k(chunks, asked, 5).count()


def test_english_analyzer(spark):
    row = spark.sql("SELECT 'The buildings are running well' AS t").select(english("t").alias("x")).first()["x"]
    assert row == [None, "build", None, "run", "well"]
    published = {"consistency": "consist", "knackeries": "knackeri", "generously": "generous", "relational": "relat", "kneaded": "knead"}
    assert {w: stem(w) for w in published} == published


def test_unknown_jurisdiction_fails(spark):
    good = spark.sql("SELECT 'nsw' AS j").select(filters.checked_jurisdiction("j").alias("j")).first()["j"]
    assert good == "NSW"
    with pytest.raises(PySparkException, match="no such jurisdiction is known: XX"):
        spark.sql("SELECT 'xx' AS j").select(filters.checked_jurisdiction("j")).collect()


def test_citable(spark):
    rows = [
        (1, "part", "ABCB Housing Provisions", "10.3 Room heights", "10.3", "Long text"),
        (2, "specification", "Code", "42 Rating software", "42", "Rating software"),
        (3, "subclause", "Code", None, None, "   "),
        (4, "part", "Code", "A1 Scope", "A1", "About it"),
    ]
    df = spark.createDataFrame(rows, "id int, node_type string, doc string, heading string, clause_id string, text string")
    assert [r["id"] for r in df.where(filters.citable()).collect()] == [4]


def test_answers(spark):
    rows = [(" [[NO_ANSWER]] not here ",), ("[[NO_ANSWER]]",), ("see [[NO_ANSWER]]",), ("",), (None,)]
    df = spark.createDataFrame(rows, "a string").select(filters.parse_answer("a").alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [
        (True, "not here"), (True, "No source found."), (False, "see [[NO_ANSWER]]"), (True, "No source found."), (True, "No source found."),
    ]


def test_requests_are_split(spark):
    df = spark.createDataFrame([(1, " a ", "q"), (2, "\n", "q"), (3, "d", None)], "id int, document_text string, query_text string")
    good, bad = filters.split_requests(df, "document_text", "query_text")
    assert [tuple(r) for r in good.collect()] == [(1, "a", "q")]
    assert sorted((r["id"], r["reason"]) for r in bad.collect()) == [(2, "document_text is blank."), (3, "query_text is blank.")]


def test_token_overlap(spark):
    df = spark.sql("SELECT 'fire wall' AS q, 'A wall.' AS p").select(token_overlap(F.col("q"), F.col("p")).alias("s"))
    assert df.first()["s"] == 0.5


def test_dense_scores_hold_few_cells_at_once(monkeypatch):
    """400 queries and a batch of 10,000 rows: 4 million cells, 32 MB an array."""
    import tracemalloc

    import pyarrow as pa

    from corpuskit.operators import dense

    def vectors(n):
        flat = np.random.default_rng(n).standard_normal(n * 8).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * 8 + 1, 8, dtype=np.int32)), pa.array(flat))

    asked = pa.RecordBatch.from_arrays([pa.array(range(400)), vectors(400), pa.nulls(400, pa.string())], names=["query_id", "qvec", "jurisdiction"])
    rows = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.nulls(10_000, pa.list_(pa.string())), vectors(10_000)], names=["id", "jurisdictions", "embedding"])
    monkeypatch.setattr(dense, "block_reader", lambda *_: lambda: iter([asked]))
    kernel = dense._kernel(None, pa.int64(), pa.int64(), 5, 6, False)
    tracemalloc.start()
    (out,) = kernel(iter([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == 2000 and peak < 40_000_000
