"""A training corpus from a documents table in stages; each is written as Parquet
and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.llm import curve_packing, decontamination, line_frequency, line_labels, queries, simhash
from corpuskit.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are mostly content (operator 6)."""
    model = line_labels.train(docs, queries.table(spark, sf_dir, "labels"))
    return line_labels.keep_content(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate of their source (operator 7)."""
    return line_frequency.drop_boilerplate(docs, F.col("source")).drop("dropped_lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 8)."""
    return simhash.keep_one(docs)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not copy a benchmark item (operator 2)."""
    return decontamination.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids (operator 3), a row per piece."""
    return curve_packing.pack(docs, queries.tokenizer_file())


STAGES = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", clean_of_tests), ("packing", packed),
]

# The line labels are a trained model's, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote stays in the shared folder
    until the caller clears it: the result reads from the last of them."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
