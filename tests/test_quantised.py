"""Search by byte codes against the exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.operators import quantised
from corpuskit.operators.dense import dense_top_k

CHUNK = "id long, node_type string, jurisdictions array<string>, embedding array<double>"
QUERY = "query_id long, qvec array<double>, jurisdiction string"


def recall(chunks, queries, k=10, **options):
    exact = {(r["query_id"], r["id"]): r["distance"] for r in dense_top_k(chunks, queries, k).collect()}
    found = {(r["query_id"], r["id"]): r["distance"] for r in quantised.top_k(quantised.build(chunks), chunks, queries, k, **options).collect()}
    assert all(found[key] == d for key, d in exact.items() if key in found)  # distances are exact
    return len(exact.keys() & found.keys()) / len(exact)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_over_the_given_vectors(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no given tables here")
    vectors = spark.read.parquet(path).select(F.col("vec_id").alias("id"), F.lit("part").alias("node_type"), F.lit(None).cast("array<string>").alias("jurisdictions"), "embedding")
    queries = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"), F.lit(None).cast("string").alias("jurisdiction"))
    share = recall(vectors, queries)
    print(sf, share)
    assert share >= 0.9


def test_recall_over_many_vectors_and_filters(spark):
    rng = np.random.default_rng(4)
    body = rng.standard_normal((20_000, 30))
    zones = [None, ["NSW"], ["VIC"]]
    chunks = spark.createDataFrame([(i, "glossary" if i % 11 == 5 else "part", zones[i % 3], None if i % 97 == 3 else v.tolist()) for i, v in enumerate(body)], CHUNK).repartition(5)
    queries = spark.createDataFrame([(i, rng.standard_normal(30).tolist(), [None, "NSW"][i % 2]) for i in range(20)] + [(20, None, None)], QUERY)
    assert recall(chunks, queries) >= 0.9
    hits = quantised.top_k(quantised.build(chunks), chunks, queries, 3).collect()
    assert all(r["id"] % 11 != 5 and r["id"] % 97 != 3 and not (r["query_id"] % 2 and r["id"] % 3 == 2) for r in hits) and len(hits) == 60


def test_codes_are_a_byte_a_part(spark):
    chunks = spark.createDataFrame([(i, "part", None, [float(i), 1.0, 2.0, float(i % 3)]) for i in range(40)] + [(40, "part", None, [0.0] * 4)], CHUNK)
    codes = quantised.build(chunks, parts=2)
    assert {len(r["code"]) for r in codes.read(spark).collect()} == {2}
    query = spark.createDataFrame([(1, [39.0, 1.0, 2.0, 0.0], None)], QUERY)
    assert quantised.top_k(codes, chunks, query, 1).first()["id"] == 39


def test_codes_of_nothing(spark):
    chunks = spark.createDataFrame([], CHUNK)
    assert quantised.top_k(quantised.build(chunks), chunks, spark.createDataFrame([(1, [1.0, 0.0], None)], QUERY), 3).count() == 0
