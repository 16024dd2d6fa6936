"""Corpus counts, audits and validation rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpuskit.functions.text import is_blank
from corpuskit.operators.ranking import union_all


def node_type_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc", "node_type").agg(F.count(F.lit(1)).alias("chunks"))


def clauses_per_doc(chunks: DataFrame) -> DataFrame:
    """Exact number of distinct clause ids over subclauses and notes."""
    counted = F.when(F.col("node_type").isin("subclause", "note") & (F.col("clause_id") != ""), F.col("clause_id"))
    return chunks.groupBy("doc").agg(F.count_distinct(counted).alias("clauses_total"))


def doc_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"))


def resolution_by_kind(refs: DataFrame) -> DataFrame:
    """References by kind: total and resolved."""
    kind = F.coalesce("kind", F.lit("unknown")).alias("kind")
    return refs.groupBy(kind).agg(
        F.count(F.lit(1)).alias("total"), F.count("chunk_id").alias("resolved")
    )


def resolution(refs: DataFrame) -> DataFrame:
    return refs.agg(
        F.count("chunk_id").alias("resolved"), F.count_if(F.col("chunk_id").isNull()).alias("unresolved")
    )


def standards_coverage(mentions: DataFrame) -> DataFrame:
    """One row: mentions matched, and how many different ones were not.
    `mentions` has mention and a nullable standard."""
    missing = F.when(F.col("standard").isNull(), F.col("mention"))
    return mentions.agg(F.count("standard").alias("matched"), F.count_distinct(missing).alias("unmatched"))


def unmatched_standards(mentions: DataFrame) -> DataFrame:
    """The different unmatched mentions, one row each."""
    return mentions.where(F.col("standard").isNull()).select("mention").distinct()


def duplicate_audit(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys held more than once: copies, and whether all copies are identical.

    Only a fixed-size hash of a row is compared, with its smallest and largest
    value, so a key with very many copies is reduced before the shuffle.
    """
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"), (F.min(digest) == F.max(digest)).alias("identical"))
        .where(F.col("copies") > 1)
    )


def settings_in_use(vectors: DataFrame) -> DataFrame:
    """Distinct (model, dim, with_heading) among stored vectors."""
    return vectors.groupBy("model", "dim", "with_heading").agg(F.count(F.lit(1)).alias("vectors"))


def check_settings(vectors: DataFrame, model: str, dim: int, with_heading: bool) -> None:
    """Refuses to mix vectors of different settings or lengths."""
    wrong = vectors.where(
        ~(
            F.col("model").eqNullSafe(F.lit(model))
            & F.col("dim").eqNullSafe(F.lit(dim))
            & F.col("with_heading").eqNullSafe(F.lit(with_heading))
            & (F.size("embedding") == dim)
        )
    )
    found = wrong.select("model", "dim", "with_heading", F.size("embedding").alias("size")).limit(1).collect()
    if found:
        raise ValueError(f"stored vectors do not match ({model}, {dim}, {with_heading}): {found[0].asDict()}")


@dataclass(frozen=True)
class Rule:
    """A row is in violation when `broken` is true."""

    name: str
    broken: Column


def one_of(column: str, *allowed: str, nullable: bool = False) -> Rule:
    outside = ~F.col(column).isin(*allowed)
    missing = F.lit(False) if nullable else F.col(column).isNull()
    return Rule(f"{column}_allowed", F.coalesce(outside, F.lit(False)) | missing)


def required(column: str) -> Rule:
    return Rule(f"{column}_required", F.col(column).isNull())


def explained_when(column: str, value: str, explanation: str) -> Rule:
    """A verdict of `value` needs a non-blank explanation."""
    return Rule(f"{column}_explained", F.coalesce(F.col(column) == value, F.lit(False)) & is_blank(explanation))


def violations(rows: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, rule) for every broken rule, in one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules]))
    return rows.select(key, F.explode(broken).alias("rule"))


def enforce(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows themselves; the job fails on the first broken rule it meets."""
    checked = rows
    for rule in rules:
        failing = F.when(rule.broken, F.raise_error(F.lit(f"rule broken: {rule.name}")).cast("boolean"))
        checked = checked.where(F.coalesce(failing, F.lit(True)))
    return checked


def dangling(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """References whose chunk id names no chunk."""
    named = refs.where(F.col("chunk_id").isNotNull())
    return named.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")


def report(counts: dict[str, DataFrame]) -> DataFrame:
    """(section, body) rows of a validation report, one JSON body per input row."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("body")) for name, df in counts.items()]
    return union_all(parts)
