"""Streams equal their batch counterparts."""

from pyspark.sql import functions as F

from corpuskit.operators.scorers import hashed_embedding
from corpuskit.sinks import runs
from corpuskit.streaming import jobs


def test_arrivals_are_embedded_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, text string, heading string"
    run = lambda mark: jobs.embed_arrivals(
        spark.readStream.schema(schema).parquet(source), out, str(tmp_path / mark), hashed_embedding(8), "m", 8
    ).awaitTermination(120)
    spark.createDataFrame([("a", "x", None), ("b", "y", None), ("a", "x", None)], schema).write.parquet(source)
    run("one")
    spark.createDataFrame([("b", "y", None), ("c", "z", None)], schema).write.mode("append").parquet(source)
    run("one")
    run("two")  # a lost checkpoint replays everything
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_running_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "conversation_id int, created_at timestamp, reported_status string, corrected_status string"
    spark.sql(
        "SELECT * FROM VALUES (1, timestamp'2024-01-01', 'missing', NULL), (1, timestamp'2024-01-03', 'missing', NULL), (2, timestamp'2024-01-02', 'missing', 'addressed') AS t(conversation_id, created_at, reported_status, corrected_status)"
    ).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    jobs.to_memory(jobs.last_activity(stream), "act", "complete").awaitTermination(120)
    assert {r[0]: r[1].day for r in spark.table("act").collect()} == {1: 3, 2: 2}
    jobs.to_memory(jobs.feedback_counts(stream), "fb", "complete").awaitTermination(120)
    assert sorted((r[1] or "", r[2]) for r in spark.table("fb").collect()) == [("", 2), ("addressed", 1)]


def test_changes_of_several_batches_and_a_replay(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "table")
    rows = spark.range(40).select((F.col("id") % 5).cast("int").alias("k"), F.col("id").alias("v"))
    rows.repartition(4, "v").write.parquet(source)

    def run(progress):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.maintain(stream.groupBy("k").agg(F.max("v").alias("v")), root, str(tmp_path / progress)).awaitTermination(120)
        return {r["k"]: r["v"] for r in jobs.read_maintained(spark, root, ["k"]).collect()}

    assert run("one") == {k: 35 + k for k in range(5)}
    assert spark.read.parquet(root).select("epoch").distinct().count() > 1
    assert run("two") == {k: 35 + k for k in range(5)}  # a lost checkpoint replays everything


def test_a_hundred_epochs_are_read_in_few_runs(spark, tmp_path):
    root = str(tmp_path / "table")
    want = {}
    for epoch in range(100):
        rows = [((epoch * 7 + i) % 40, epoch) for i in range(3)]
        runs.add_run(spark.createDataFrame(rows, "k int, v int").coalesce(1), root, epoch, ["k"], fan=4)
        want.update(rows)
    number, held = runs.runs_of(spark, root)
    assert number == 100 and len(held) <= 3 * 4 + 4
    assert [r.first for r in held[1:]] == [r.past for r in held[:-1]] and held[-1].past == 100
    read = lambda: {r["k"]: r["v"] for r in runs.read_runs(spark, root, ["k"]).collect()}
    assert read() == want
    # The last epoch is run again, with other rows.
    runs.add_run(spark.createDataFrame([(0, -1)], "k int, v int"), root, 99, ["k"], fan=4)
    assert read()[0] == -1
    assert runs.remove_merged(spark, root) > 80 and read()[0] == -1


def test_merged_runs_of_a_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "table")
    rows = spark.range(90).select((F.col("id") % 7).cast("int").alias("k"), F.col("id").alias("v"))
    for part in range(9):
        rows.where(F.col("v") % 9 == part).coalesce(1).write.mode("append").parquet(source)

    def run(progress):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        counted = stream.groupBy("k").agg(F.count("v").alias("n"))
        jobs.maintain(counted, root, str(tmp_path / progress), ["k"], fan=2).awaitTermination(240)
        return {r["k"]: r["n"] for r in jobs.read_maintained(spark, root, ["k"]).collect()}

    want = {k: len(range(k, 90, 7)) for k in range(7)}
    assert run("one") == want and len(runs.runs_of(spark, root)[1]) <= 5
    assert run("two") == want  # a lost checkpoint starts over


def test_arrivals_in_many_batches_read_no_vectors(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "id string, text string, heading string"
    for part in range(4):
        rows = [(f"i{i}", "" if part == 0 and i == 0 else "w", None) for i in range(part * 5 - part, part * 5 + 5)]
        spark.createDataFrame([*rows, ("i0", "w" if part == 3 else "", None)], schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.embed_arrivals(stream, out, mark, hashed_embedding(8), "m", 8).awaitTermination(240)

    run()
    stored = spark.read.parquet(out)
    assert sorted(r["id"] for r in stored.collect()) == sorted(f"i{i}" for i in range(20))
    assert stored.select("epoch").distinct().count() == 4
    run()
    assert spark.read.parquet(out).count() == 20
