"""Keyed changes to a table, as plain joins. Each returns the new table state;
`sinks.tables.publish` makes it current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window, functions as F

from corpuskit.operators.ranking import best_rows, union_all


def upsert(target: DataFrame, source: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """Rows of `source` replace rows with the same key, the rest stay. `source`
    must hold one row per key (see `best_rows`)."""
    keys = [key] if isinstance(key, str) else key
    return union_all([target.join(source.select(*keys), keys, "left_anti"), source])


def insert_ignore(target: DataFrame, source: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is already there are ignored."""
    return union_all([target, source.join(target.select(key), key, "left_anti")])


def update_columns(
    target: DataFrame, changes: DataFrame, columns: Sequence[str], key: str = "id", order: str | None = None
) -> DataFrame:
    """Sets `columns` of the rows named by key. An explicit NULL is written.

    Of several changes for a key the last by `order` is taken; without an order
    they fail the job, since nothing says which one holds.
    """
    changes = best_rows(changes, [key], F.col(order), "last") if order else single_rows(changes.select(key, *columns), [key])
    renamed = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = target.join(renamed, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


def single_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows`, failing the job where a key has more than one. The window's sort by
    key also serves a sort-merge join on it."""
    many = F.raise_error(F.concat(F.lit("several rows for key "), F.to_json(F.struct(*keys)))).cast("boolean")
    counted = rows.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return counted.where(F.when(F.col("_rows") > 1, many).otherwise(F.lit(True))).drop("_rows")


def delete_cascade(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, fk: str):
    """(parents, children) without the `doomed` parents and everything under them."""
    gone = doomed.select(key).distinct()
    return (
        parents.join(gone, key, "left_anti"),
        children.join(gone.withColumnRenamed(key, fk), fk, "left_anti"),
    )


def delete_set_null(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, fk: str):
    """(parents, children): children of a deleted parent stay, unattached."""
    gone = doomed.select(F.col(key).alias(fk), F.lit(True).alias("_gone")).distinct()
    detached = children.join(gone, fk, "left").select(
        *[F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c == fk else F.col(c) for c in children.columns]
    )
    return parents.join(doomed.select(key).distinct(), key, "left_anti"), detached


def repair_truncated(stored: DataFrame, fresh: DataFrame, key: str = "id", text: str = "text"):
    """(repaired table, backup of the old values, observation): rows whose stored
    text is a strict prefix of the fresh one get the fresh text; any other
    difference is left alone.

    One join decides for each row and nothing runs before the results are used. A
    key with several fresh rows fails the job. The observation counts the `changed`
    rows while the repaired table is written: see `require_changes`.
    """
    new = single_rows(fresh.select(key, F.col(text).alias("_new")), [key])
    longer = F.coalesce(F.startswith("_new", F.col(text)) & (F.col("_new") != F.col(text)), F.lit(False))
    joined = stored.join(new, key, "left").withColumn("_changed", longer)
    changes = Observation()
    values = [F.when(F.col("_changed"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in stored.columns]
    repaired = joined.observe(changes, F.count_if("_changed").alias("changed")).select(*values)
    return repaired, joined.where("_changed").select(key, F.col(text).alias("old_text")), changes


def require_changes(changes: Observation, planned: int) -> None:
    """Call between writing a repaired table and making it current."""
    changed = changes.get["changed"]
    if changed != planned:
        raise RuntimeError(f"{planned} changes were planned and {changed} rows changed; the table is not made current")


def pending(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Work not done yet. `done` may hold a key many times."""
    return work.join(done.select(key), key, "left_anti")


def queue(work: DataFrame, done: DataFrame, failed: DataFrame, mode: str = "new", key: str = "id") -> DataFrame:
    """What to process: 'new' = not done; 'retry' = failed and not done;
    'overwrite' = everything; 'overwrite-retry' = everything that failed."""
    if mode in ("retry", "overwrite-retry"):
        work = work.join(failed.select(key), key, "left_semi")
    return work if mode.startswith("overwrite") else pending(work, done, key)


def outstanding_errors(errors: DataFrame, succeeded: DataFrame, key: str, order: str) -> DataFrame:
    """Latest error per key, without keys that have since succeeded, by key."""
    open_errors = pending(errors, succeeded, key)
    return best_rows(open_errors, [key], F.col(order), "last").orderBy(key)
