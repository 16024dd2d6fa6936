"""Dealing review work to groups, evenly per corpus and repeatably."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from corpuskit.operators.ranking import ordered_positions, union_all

GROUPS = ("a", "b", "c")


def _shortfalls(items: DataFrame, pinned: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(corpus, grp, ord, short): how far each group is below its even share."""
    table = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(i).alias("ord")) for i, g in enumerate(groups)])
    held = (
        items.join(pinned, "key")
        .groupBy("corpus", "grp")
        .agg(F.count(F.lit(1)).alias("held"))
    )
    sizes = items.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.select("corpus", "n", F.inline(table)).join(held, ["corpus", "grp"], "left")
    share = F.floor(F.col("n") / len(groups)) + F.when(F.col("ord") < F.col("n") % len(groups), 1).otherwise(0)
    return each.select("corpus", "grp", "ord", F.greatest(share - F.coalesce("held", F.lit(0)), F.lit(0)).alias("short"))


def _rounds(shortfalls: DataFrame) -> DataFrame:
    """(corpus, from_pos, to_pos, members): stretches of the deal served in turn
    by the same groups. The neediest group is served alone until the next one
    needs as much, then both in turn, and so on."""
    by_need = F.array_sort(F.collect_list(F.struct((-F.col("short")).alias("need"), "ord", "grp")))
    per_corpus = shortfalls.groupBy("corpus").agg(by_need.alias("g"))
    level = lambda m: -F.coalesce(F.get("g", m)["need"], F.lit(0))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("g")),
        lambda m: F.struct(
            m.alias("m"),
            ((level(m - 1) - level(m)) * m).alias("n"),
            F.array_sort(F.transform(F.slice("g", F.lit(1), m), lambda x: F.struct(x["ord"], x["grp"]))).alias("members"),
        ),
    )
    rows = per_corpus.select("corpus", F.inline(steps))
    upto = F.sum("n").over(Window.partitionBy("corpus").orderBy("m"))
    return rows.select("corpus", (upto - F.col("n")).alias("from_pos"), upto.alias("to_pos"), "members")


def deal(items: DataFrame, pinned: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """(key, corpus, grp, pinned): pinned items keep their group; the others, in
    key order, each go to the group furthest below its share (ties: group order).

    items: key, corpus. pinned: key, grp. The deal is computed from positions,
    so a corpus with most of the items is numbered in ranges, not in one task.
    """
    known = pinned.where(F.col("grp").isin(*groups)).select("key", "grp")
    rounds = _rounds(_shortfalls(items.select("key", "corpus"), known, groups))
    free = ordered_positions(items.select("key", "corpus").join(known, "key", "left_anti"), ["corpus"], "key")
    inside = (F.col("position") > F.col("from_pos")) & (F.col("position") <= F.col("to_pos"))
    turn = (F.col("position") - F.col("from_pos") - 1) % F.size("members")
    dealt = (
        free.join(rounds, "corpus")
        .where(inside)
        .select("key", "corpus", F.get("members", turn.cast("int"))["grp"].alias("grp"), F.lit(False).alias("pinned"))
    )
    kept = items.select("key", "corpus").join(known, "key").select("key", "corpus", "grp", F.lit(True).alias("pinned"))
    return union_all([dealt, kept])


def progress(assigned: DataFrame, verdicts: DataFrame, corpora: Sequence[str], before: DataFrame | None = None) -> DataFrame:
    """One row per group: total, count per corpus, reviewed, correct, incorrect,
    pinned, and moved when an earlier assignment (key, grp) is given."""
    joined = assigned.join(verdicts.select("key", "verdict"), "key", "left")
    if before is not None:
        joined = joined.join(before.select("key", F.col("grp").alias("_before")), "key", "left")
    else:
        joined = joined.withColumn("_before", F.lit(None).cast("string"))
    return joined.groupBy("grp").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("corpus") == c).alias(c) for c in corpora],
        F.count("verdict").alias("reviewed"),
        F.count_if(F.col("verdict") == "correct").alias("correct"),
        F.count_if(F.col("verdict") == "incorrect").alias("incorrect"),
        F.count_if("pinned").alias("pinned"),
        F.count_if(F.col("_before") != F.col("grp")).alias("moved"),
    )


def reviewable(descriptions: DataFrame, images: DataFrame) -> DataFrame:
    """Descriptions with text whose image is there. images: corpus, image."""
    usable = descriptions.where((F.col("image") != "") & (F.col("description") != ""))
    return usable.join(images.select("corpus", "image"), ["corpus", "image"], "left_semi").withColumn(
        "key", F.concat_ws("/", "corpus", "image")
    )
