"""Checking answers against expected clauses and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def judge(expected: DataFrame, results: DataFrame) -> DataFrame:
    """expected: qid, clauses, phrases. results: qid, answer, chips, abstained.
    A question without expected clauses has no clause_hit."""
    joined = expected.join(results, "qid")
    answer = F.lower(F.coalesce("answer", F.lit("")))
    said = lambda p: F.contains(answer, F.lower(p))
    chips = F.coalesce("chips", F.array().cast("array<string>"))
    return joined.select(
        "qid",
        "abstained",
        F.when(F.size("clauses") > 0, F.arrays_overlap("clauses", chips)).alias("clause_hit"),
        F.filter("phrases", said).alias("text_hit"),
        F.filter("phrases", lambda p: ~said(p)).alias("text_missing"),
    )


def summarise(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if("clause_hit").alias("clause_hits"),
        F.count("clause_hit").alias("clause_checks"),
        F.sum(F.size("text_missing")).alias("phrases_missing"),
        F.count_if("abstained").alias("abstained"),
    )


def still_to_run(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Questions without a successful result yet (status 200)."""
    return expected.join(results.where(F.col("status") == 200).select("qid"), "qid", "left_anti")
