"""Chunk files, description stores, image listings and review state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuskit.functions.text import basename, blank_to_null, is_blank, stem
from corpuskit.operators.ranking import best_rows, union_all
from corpuskit.schemas import CHUNK_FILE
from corpuskit.sources.structured import local_path, local_path_of


def file_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_path, file_ord): every file under `paths` (files or folders) with the number
    of the path that names it: its own, else its nearest folder; of equal paths the
    last. The files are listed, not read."""
    named = spark.createDataFrame(list(enumerate(paths)), "file_ord int, given string").select("file_ord", local_path("given").alias("given"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(local_path("path").alias("_path"))
    parts = F.split("_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    met = found.select("_path", F.posexplode(up).alias("depth", "given")).join(named, "given")
    return met.groupBy("_path").agg(F.max(F.struct("depth", "file_ord"))["file_ord"].alias("file_ord"))


def with_file_order(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Adds `file_ord` to rows with the `_path` they were read from, and drops that.
    A path that none of `paths` accounts for fails the read."""
    lost = F.raise_error(F.concat(F.lit("file order is unknown for "), F.col("_path"))).cast("int")
    joined = rows.join(file_order(rows.sparkSession, paths), "_path", "left")
    return joined.withColumn("file_ord", F.coalesce("file_ord", lost)).drop("_path")


def read_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Chunk records of JSON array files, later files after earlier ones
    (`file_ord`). A missing file, malformed JSON or anything but a list of
    records fails the read."""
    reader = spark.read.schema(CHUNK_FILE).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True)
    rows = reader.json(paths).withColumn("_path", local_path("_metadata.file_path", encoded=True)).withColumn(
        "row_ord", F.monotonically_increasing_id()
    )
    checked = F.when(F.col("id").isNull(), F.raise_error(F.lit("every chunk needs an id"))).otherwise(F.col("id"))
    return with_file_order(rows.withColumn("id", checked), paths)


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Prefers the embedded form of a chunk where there is one."""
    return chunks.drop("embedding").join(vectors.select("id", "embedding"), "id", "left")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Text lines with a repeatable order: file, start of its split, row in the split."""
    rows = spark.read.option("recursiveFileLookup", True).text(paths).select(
        "value",
        local_path("_metadata.file_path", encoded=True).alias("_path"),
        F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).alias("_place"),
    )
    place = F.struct(F.col("file_ord").alias("file"), F.col("_place.at").alias("at"), F.col("_place.n").alias("n"))
    return with_file_order(rows, paths).select("value", place.alias("line"))


def read_jsonl(spark: SparkSession, paths: list[str], schema: T.StructType, required: list[str]) -> DataFrame:
    """Records of JSONL files with their `line` order. Blank and malformed lines
    and records without a required value are skipped."""
    parsed = _lines(spark, paths).where(~is_blank("value")).select(
        F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "line"
    )
    rows = parsed.select("r.*", "line")
    for name in required:
        kind = schema[name].dataType
        rows = rows.where(F.col(name).isNotNull() if not isinstance(kind, T.StringType) else F.col(name) != "")
    return rows


def read_flat_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(image, description, line) of flat {image: text} JSON files. Values that
    are not text, and blank ones, are left out; files that are not objects are skipped."""
    files = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True).select("value", local_path("_metadata.file_path", encoded=True).alias("_path"))
    entries = (
        with_file_order(files, paths).select(F.col("file_ord").alias("file"), F.try_parse_json("value").alias("v"))
        .where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
        .select("file", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("image", "value"))
    )
    return (
        entries.where(F.schema_of_variant("value") == "STRING")
        .select(
            "image",
            F.try_variant_get("value", "$", "string").alias("description"),
            F.struct("file", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n")).alias("line"),
        )
        .where(~is_blank("description"))
    )


def description_additions(*stores: DataFrame) -> DataFrame:
    """(name, stem, text, at) of (image, description, line) tables in store order."""
    tagged = [
        s.select(
            basename("image").alias("name"),
            stem("image").alias("stem"),
            F.col("description").alias("text"),
            F.struct(F.lit(i).alias("store"), "line").alias("at"),
        )
        for i, s in enumerate(stores)
    ]
    return union_all(tagged)


def description_store(additions: DataFrame) -> DataFrame:
    """(name, text): the last description added for a file name."""
    return best_rows(additions.select("name", "text", "at"), ["name"], F.col("at"), "last").drop("at")


def description_stems(additions: DataFrame) -> DataFrame:
    """(stem, text): the first description added for a file name without suffix."""
    return best_rows(additions.select("stem", "text", "at"), ["stem"], F.col("at"), "first").drop("at")


def describe(figures: DataFrame, file_name: str, additions: DataFrame) -> DataFrame:
    """Adds `description`: by exact file name, else (also for an empty text) by stem."""
    exact = description_store(additions).select(F.col("name").alias("_name"), F.col("text").alias("_exact"))
    stems = description_stems(additions).select(F.col("stem").alias("_stem"), F.col("text").alias("_by_stem"))
    keyed = figures.withColumn("_name", basename(file_name)).withColumn("_stem", stem(file_name))
    found = F.coalesce(blank_to_null("_exact"), F.col("_by_stem"))
    joined = keyed.join(exact, "_name", "left").join(stems, "_stem", "left").withColumn("description", found)
    return joined.drop("_name", "_stem", "_exact", "_by_stem")


def find_files(spark: SparkSession, roots: list[str], extensions: list[str]) -> DataFrame:
    """(path, label, name) of every file with one of the extensions under the
    roots, once each. The label is the path below the first root holding it."""
    wanted = [e.lstrip(".").lower() for e in extensions]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(roots)
        .select(local_path("path").alias("path"))
        .where(F.lower(F.substring_index(basename("path"), ".", -1)).isin(*wanted) & F.contains(basename("path"), F.lit(".")))
        .distinct()
    )
    label = F.lit(None).cast("string")
    for root in reversed(roots):
        base = F.concat(local_path_of(root), F.lit("/"))
        label = F.when(F.startswith("path", base), F.substr("path", F.length(base) + 1)).otherwise(label)
    return files.select("path", F.coalesce(label, basename("path")).alias("label"), basename("path").alias("name"))


def read_review_state(spark: SparkSession, folder: str, groups: list[str], valid_keys: DataFrame) -> DataFrame:
    """(key, grp, verdict) of group-*.json files; unreadable files, unknown
    groups and keys not in `valid_keys` are skipped. A later group wins."""
    files = spark.read.text(f"{folder}/group-*.json", wholetext=True).select(
        "value", F.regexp_extract("_metadata.file_path", r"group-([^/]*)\.json$", 1).alias("grp")
    )
    results = F.from_json("value", "results map<string, struct<verdict:string>>")["results"]
    entries = (
        files.where(F.col("grp").isin(*groups))
        .select("grp", F.explode(results).alias("key", "entry"))
        .select("key", "grp", F.col("entry.verdict").alias("verdict"))
        .where(F.col("verdict") != "")
    )
    known = entries.join(valid_keys.select("key"), "key", "left_semi")
    return best_rows(known, ["key"], F.col("grp"), "last")
