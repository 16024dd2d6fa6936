"""Bucketed tables against plain joins, and what a change touches."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpuskit.sinks import buckets

SCHEMA = "id long, text string, n int"


def content(spark, root, number=None):
    return {r["id"]: (r["text"], r["n"]) for r in buckets.read(spark, root, number).collect()}


def folders(version):
    return {path for path, _ in version.buckets.values() if path}


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(0).alias("n"))
    assert buckets.create(rows, root, "id", bucket_rows=100) == 1
    return root


def test_a_change_of_one_buckets_keys_writes_one_bucket(spark, table):
    before = buckets.version_of(spark, table)
    assert len(before.buckets) == 16 and sum(n for _, n in before.buckets.values()) == 1000
    bucket, (path, _) = next(iter(before.buckets.items()))
    some = spark.read.parquet(f"{table}/{path}").limit(2).withColumn("n", F.lit(7))
    buckets.upsert(table, some)
    after = buckets.version_of(spark, table)
    assert after.number == 2
    assert folders(before) - folders(after) == {path}
    assert len(folders(after) - folders(before)) == 1
    assert sum(v == 7 for _, v in content(spark, table).values()) == 2
    read = buckets.read_keys(table, some.select("id")).inputFiles()
    assert {os.path.basename(os.path.dirname(f)) for f in read} == {f"_bucket={bucket}"}


def test_random_changes_equal_a_dictionary(spark, table):
    rng = random.Random(5)
    want = content(spark, table)
    states = {1: dict(want)}
    for step in range(6):
        ids = rng.sample(range(3000), 300)
        if step % 3 == 0:
            number = buckets.upsert(table, spark.createDataFrame([(i, f"u{step}", step) for i in ids], SCHEMA))
            want.update({i: (f"u{step}", step) for i in ids})
        elif step % 3 == 1:
            changes = spark.createDataFrame([(i, None, -step) for i in ids], SCHEMA)
            number = buckets.update(table, changes, ["text", "n"])
            want.update({i: (None, -step) for i in ids if i in want})
        else:
            number = buckets.delete(table, spark.createDataFrame([(str(i),) for i in ids], "id string"))
            want = {i: v for i, v in want.items() if i not in set(ids)}
        states[number] = dict(want)
        assert content(spark, table) == want
    for number, state in states.items():
        assert content(spark, table, number) == state
    assert buckets.remove_old(spark, table) > 0
    assert content(spark, table) == want
    with pytest.raises(ValueError):
        buckets.read(spark, table, 1)


def test_buckets_divide_as_the_table_grows(spark, table):
    grown = spark.range(500, 9000).select("id", F.lit("g").alias("text"), F.lit(1).alias("n"))
    buckets.upsert(table, grown)
    version = buckets.version_of(spark, table)
    sizes = [n for _, n in version.buckets.values()]
    assert sum(sizes) == 9000 and max(sizes) < 200
    # Depths differ once only some buckets are touched.
    bucket, (path, _) = next(iter(version.buckets.items()))
    hot = spark.range(100_000, 150_000).select("id", F.lit("h").alias("text"), F.lit(2).alias("n"))
    depth = bucket.bit_length() - 1
    inside = hot.where(F.xxhash64("id").bitwiseAND(F.lit((1 << depth) - 1)) == bucket - (1 << depth))
    added = inside.count()
    buckets.upsert(table, inside)
    after = buckets.version_of(spark, table)
    assert len({b.bit_length() for b in after.buckets}) > 1
    assert folders(version) - folders(after) == {path}
    everything = spark.range(160_000).select("id")
    assert buckets.read_keys(table, everything).count() == 9000 + added == buckets.read(spark, table).count()
    buckets.update(table, everything.withColumn("n", F.lit(9)), ["n"])
    assert buckets.read(spark, table).where("n = 9").count() == 9000 + added


def test_repair_changes_prefixes_only_and_keeps_a_backup(spark, table):
    fresh = spark.createDataFrame([(1, "t1 whole"), (2, "other"), (3, "t3"), (5000, "t")], "id long, text string")
    number, backup = buckets.repair(table, fresh)
    assert [tuple(r) for r in backup.select("id", "old_text", "text").collect()] == [(1, "t1", "t1 whole")]
    assert content(spark, table)[1][0] == "t1 whole" and content(spark, table)[2][0] == "t2"
    assert len(folders(buckets.version_of(spark, table)) - folders(buckets.version_of(spark, table, 1))) == 1
    assert buckets.repair(table, fresh)[0] == number  # nothing left to change


def test_what_fails_changes_nothing(spark, table):
    for bad in ([(1, "a", 1), (1, "b", 2)], [(None, "a", 1)]):
        with pytest.raises(PySparkException):
            buckets.upsert(table, spark.createDataFrame(bad, SCHEMA))
    assert buckets.version_of(spark, table).number == 1
    assert buckets.update(table, spark.createDataFrame([(5000, "x", 1)], SCHEMA), ["n"]) == 1


def test_an_empty_table_fills(spark, tmp_path):
    root = str(tmp_path / "empty")
    buckets.create(spark.createDataFrame([], SCHEMA), root, "id", bucket_rows=10)
    assert content(spark, root) == {}
    buckets.upsert(root, spark.createDataFrame([(i, "x", i) for i in range(50)], SCHEMA))
    assert len(content(spark, root)) == 50 and len(buckets.version_of(spark, root).buckets) == 8
    buckets.delete(root, spark.range(50))
    assert content(spark, root) == {}
