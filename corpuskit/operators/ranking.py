"""Ranks, top-k and deduplication that hold up when one key owns most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows of every key, ranked from 1.

    The rank filter lets Spark cut each input partition to k rows per key
    before the shuffle, so a hot key ships at most k rows per partition.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def merge_top_k(
    df: DataFrame, keys: Sequence[str], spread_by: str, order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """`top_k` over partial lists. On a wide cluster the partial lists of one
    key are first merged in slices, so no task sees partitions x k rows."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if width > 64:
        slot = F.pmod(F.xxhash64(spread_by), F.lit(int(width**0.5)))
        df = top_k(df.withColumn("_slot", slot), [*keys, "_slot"], order, k, "_partial").drop("_slot", "_partial")
    return top_k(df, keys, order, k, rank)


def best_rows(df: DataFrame, keys: Sequence[str], order: Column, keep: str) -> DataFrame:
    """One whole row per key: the `keep`='first' or 'last' one by `order`; a row
    without an order value comes after all others.

    The rank filter lets Spark cut each input partition to one row per key before
    the shuffle, so copies of a hot key stay where they are.
    """
    placed = order.asc_nulls_last() if keep == "first" else order.desc_nulls_last()
    return top_k(df, keys, [placed], 1, "_best").drop("_best").select(*df.columns)


def splitters(df: DataFrame, key: str, pieces: int) -> list:
    """About `pieces` - 1 values that cut `df` evenly by `key`.

    Taken from the rows with the smallest key hashes: a uniform, repeatable
    sample of fixed size, found with a bounded top-n.
    """
    sample_size = pieces * 16
    hashed = df.select(key, F.xxhash64(key).alias("_h")).distinct()
    sample = sorted(row[0] for row in hashed.orderBy("_h", key).limit(sample_size).collect())
    step = max(len(sample) // pieces, 1)
    return sample[step::step][: pieces - 1]


def ordered_positions(
    df: DataFrame, groups: Sequence[str], key: str, position: str = "position", pieces: int = 64
) -> DataFrame:
    """row_number() over (partition by groups order by key), 1-based, for groups
    of any size; `key` must be unique within a group.

    Rows are cut by key range, counted per range, and numbered inside a range
    on top of the counts before it. No task holds more than one range.
    """
    cuts = splitters(df, key, pieces)
    if not cuts:
        window = Window.partitionBy(*groups).orderBy(key)
        return df.withColumn(position, F.row_number().over(window))
    piece = F.when(F.col(key) < F.lit(cuts[0]), 0)
    for n, bound in enumerate(cuts[1:], 1):
        piece = piece.when(F.col(key) < F.lit(bound), n)
    piece = piece.otherwise(len(cuts))
    cut = df.withColumn("_piece", piece)
    sizes = cut.groupBy(*groups, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*groups, "_piece").orderBy(key)
    local = cut.withColumn("_local", F.row_number().over(inside))
    joined = local.join(offsets, [*groups, "_piece"])
    return joined.withColumn(position, F.col("_local") + F.col("_offset")).drop("_local", "_offset", "_piece")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name.

    Spark 4.1 lets a union keep its children's partitioning and then zips their
    partitions; when adaptive execution has coalesced the children differently
    the job fails. The setting turns that shortcut off.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(lambda a, b: a.unionByName(b), frames)
