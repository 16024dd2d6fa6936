"""Model surfaces. A model is a plain function over a batch; it is loaded once
per worker by the iterator form of a pandas UDF. The defaults are deterministic,
need no model and stay native."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuskit.functions.analyzer import simple

EMBED_BATCH = 20  # texts per call to an embedding model
STATUSES = ("addressed", "missing", "contradicted", "needs_review")


# -- embedding -----------------------------------------------------------------

def hashed_embedding(dim: int = 64) -> Callable[[Column], Column]:
    """Offline embedding: unit-length hashed bag of words. Words are hashed
    natively; only small integers reach Python."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def count(slots: pd.Series) -> pd.Series:
        import numpy as np

        lengths = np.array([0 if row is None else len(row) for row in slots], dtype=np.int64)
        flat = np.concatenate([row for row in slots if row is not None and len(row)] or [np.zeros(0, np.int64)]).astype(np.int64)
        at = np.repeat(np.arange(len(slots)), lengths) * dim + flat
        counts = np.bincount(at, minlength=len(slots) * dim).reshape(len(slots), dim)
        vectors = (counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        return pd.Series([v if n else None for v, n in zip(vectors, lengths)], index=slots.index)

    def slot(word: Column) -> Column:
        # The first 32 bits of md5, which any engine has.
        return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")

    def embed(text: Column) -> Column:
        return count(F.transform(simple(text), slot))

    return embed


def batch_embedding(
    load: Callable[[], Callable[[list[str]], list[list[float]]]], batch_size: int = EMBED_BATCH
) -> Callable[[Column], Column]:
    """Embedding by a model: `load` runs once per worker and returns the batch
    function. A model that returns another number of vectors fails the job."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors: list = []
            for start in range(0, len(texts), batch_size):
                asked = texts.iloc[start : start + batch_size].tolist()
                got = model(asked)
                if len(got) != len(asked):
                    raise ValueError(f"asked for {len(asked)} vectors, got {len(got)}")
                vectors.extend(list(v) for v in got)
            yield pd.Series(vectors, index=texts.index)

    return run


# -- pair scoring ----------------------------------------------------------------

def token_overlap(query: Column, passage: Column) -> Column:
    """Offline pair score in 0..1: share of the query's distinct words in the passage."""
    asked = F.array_distinct(simple(query))
    found = F.size(F.array_intersect(asked, simple(passage)))
    return F.when(F.size(asked) > 0, F.round(found / F.size(asked), 6)).otherwise(F.lit(0.0))


def batch_pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable:
    """Pair scoring by a model, one call per Arrow batch."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, passages in batches:
            pairs = list(zip(queries, passages.fillna("")))
            scores = model(pairs)
            if len(scores) != len(pairs):
                raise ValueError(f"{len(pairs)} passages went to the model and {len(scores)} scores came back")
            yield pd.Series([float(s) for s in scores], index=queries.index)

    return run


# -- classification ----------------------------------------------------------------

def overlap_classifier(requirement: Column, document: Column) -> Column:
    """Offline classifier: 'missing' when no word is shared, else 'needs_review'."""
    shared = F.size(F.array_intersect(simple(requirement), simple(document)))
    status = F.when(shared > 0, F.lit("needs_review")).otherwise(F.lit("missing"))
    return F.struct(
        status.alias("status"),
        F.concat(shared.cast("string"), F.lit(" shared words")).alias("explanation"),
        F.lit(None).cast("string").alias("evidence"),
    )


def checked_status(status: Column) -> Column:
    """A status outside the known ones fails the job."""
    wrong = F.raise_error(F.concat(F.lit("Unknown status: "), F.coalesce(status, F.lit("NULL"))))
    return F.when(status.isin(*STATUSES), status).otherwise(wrong.cast("string"))


# -- error-carrying rows -------------------------------------------------------------

def guarded(load: Callable[[], Callable[[str], str]], attempts: int = 1) -> Callable[[Column], Column]:
    """Per-row model call whose failure becomes a value: struct<ok, value, error, attempts>."""
    schema = T.StructType(
        [
            T.StructField("ok", T.BooleanType()),
            T.StructField("value", T.StringType()),
            T.StructField("error", T.StringType()),
            T.StructField("attempts", T.IntegerType()),
        ]
    )

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def attempt(value):
            error = None
            for n in range(1, attempts + 1):
                try:
                    return True, model(value), None, n
                except Exception as exc:  # noqa: BLE001 - any failure is data here
                    error = f"{type(exc).__name__}: {exc}"
            return False, None, error, attempts

        for inputs in batches:
            yield pd.DataFrame([attempt(v) for v in inputs], columns=["ok", "value", "error", "attempts"])

    return run


def split_results(df: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """(rows that worked, rows that failed) of a `guarded` column."""
    good = df.where(F.col(f"{result}.ok"))
    bad = df.where(~F.col(f"{result}.ok"))
    return good, bad
