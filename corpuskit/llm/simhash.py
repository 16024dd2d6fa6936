"""Near duplicates by SimHash: 64-bit fingerprints linked at a small Hamming
distance, found by multi-index hashing.

Fingerprints are cut into segments. If two differ in at most `distance` bits,
then some segment i differs in at most r_i bits, where the r_i + 1 add up to
distance + 1. Each distinct fingerprint is therefore filed under every value of
the small Hamming ball around each of its segments; fingerprints that meet under
a value are compared in full. No link is lost.

A table of distinct fingerprints is filed, so exact copies cost nothing. Where
very many fingerprints meet under one value, that meeting is dealt out as pairs
of blocks. Inside a meeting, links come from a search that leaves a fingerprint
once it is reached, so a dense family gives a tree of links, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from corpuskit.llm.components import components
from corpuskit.session import cut_lineage

DISTANCE = 4
SHINGLE = 4
SEED = 42
BLOCK = 8192  # fingerprints of a meeting handled together
PARTS = 32  # a component's rows are dealt out so many ways
FEW = 24  # meetings up to this size are compared pair by pair, all at once


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word n-grams of a text: A-Z lower-cased, words are
    [^\\x20\\x09-\\x0D]+, repeats count, fewer words than n form one gram, no word
    gives 0. A bit is set if it is set in over half the gram hashes."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) <= n:
        return xxhash.xxh64_intdigest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[: -n] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist())), "<u8", len(parts) - n + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in parts
        part = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, fp): a row per input row; fp is the fingerprint as a signed long. A
    null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = np.fromiter((fingerprint(t.as_py() or b"", n) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fp long")


def segments(count: int, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment, for about `count` fingerprints:
    the number of segments with the least filings and chance meetings."""

    def plan(m: int) -> list[tuple[int, int]]:
        radii = [(distance + 1) // m - 1 + (i < (distance + 1) % m) for i in range(m)]
        return list(zip([64 // m + (i < 64 % m) for i in range(m)], radii))

    def cost(m: int) -> float:
        balls = [(w, sum(comb(w, r) for r in range(radius + 1))) for w, radius in plan(m)]
        return sum(ball * (1 + count / 2.0**w) for w, ball in balls)

    best = min(range(2, distance + 2), key=cost)
    out, shift = [], 0
    for width, radius in plan(best):
        out.append((shift, width, radius))
        shift += width
    return out


def _filed(distinct: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(slot, fp): the values around each segment of each fingerprint. Of two
    values that differ, flips are listed from the one whose lowest differing bit
    is set, so a pair meets once a segment."""
    masks = []
    for shift, width, radius in plan:
        flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
        lowest = [f & -f for f in flips]
        masks.append((shift, width, np.array(flips, np.uint64), np.array(lowest, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 4096):
                fps = every[at : at + 4096]
                slots, owners = [], []
                for number, (shift, width, flips, lowest) in enumerate(masks):
                    value = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                    keep = (value[:, None] & lowest) == lowest
                    # Segment numbers stand above the widest segment's values.
                    slot = (value[:, None] ^ flips) | (np.uint64(number) << np.uint64(max(w for _, w, _, _ in masks)))
                    slots.append(slot[keep])
                    owners.append(np.broadcast_to(fps[:, None], keep.shape)[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(slots).view(np.int64)), pa.array(np.concatenate(owners).view(np.int64))], names=["slot", "fp"]
                )

    return distinct.select("fp").mapInArrow(run, "slot long, fp long")


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _tree(fps: np.ndarray, distance: int) -> tuple[list, list]:
    """Links that connect what is connected by links among `fps`."""
    left, right = [], []
    rest = np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = _close(rest, node, distance)
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), node))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    return left, right


def _links(slots: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each meeting; `slots` are sorted."""
    begin = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    size = np.diff(np.concatenate([begin, [len(slots)]]))
    left, right = [], []
    small = np.repeat((size > 1) & (size <= FEW), size)
    for step in range(1, FEW):
        at = np.flatnonzero(small[:-step] & (slots[:-step] == slots[step:])) if step < len(slots) else ()
        if not len(at):
            break
        at = at[_close(fps[at], fps[at + step], distance)]
        left.append(fps[at])
        right.append(fps[at + step])
    for i in np.flatnonzero(size > FEW):
        a, b = _tree(fps[begin[i] : begin[i] + size[i]], distance)
        left += a
        right += b
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def links(distinct: DataFrame, count: int, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs of `distinct`
    (fp) within the distance do. Every row is a true link."""
    filed = _filed(distinct, segments(count, distance))
    # Meetings beyond a block, if any, are met as pairs of blocks.
    crowds = filed.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    crowds = cut_lineage(crowds.select("slot", F.ceil(2 * F.col("n") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = (
        filed.join(crowds, "slot").select("slot", "fp", own.alias("own"), other.alias("other"))
        .select(F.xxhash64("slot", F.least("own", "other"), F.greatest("own", "other")).alias("part"), "slot", "fp")
    )
    whole = filed.join(crowds, "slot", "left_anti").select(F.col("slot").alias("part"), "slot", "fp")
    distinct.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    meetings = whole.unionByName(split).repartition("part").sortWithinPartitions("part", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_part, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(parts, fps):
            a, b = _links(parts, fps, distance) if len(parts) else (fps, fps)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            parts = np.concatenate([held_part, batch.column(0).to_numpy()])
            fps = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            if not len(parts):
                continue
            cut = int(np.searchsorted(parts, parts[-1], side="left"))  # the last meeting may go on
            if cut:
                yield out(parts[:cut], fps[:cut])
            held_part, held = parts[cut:], fps[cut:]
        yield out(held_part, held)

    return meetings.select("part", "fp").mapInArrow(run, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, n: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id): a row per input row. component_id is the
    smallest non-null id reachable over links at `distance` or fewer bits, its own
    included.

    Null and blank texts share the fingerprint zero and so link with each other.
    Repeated ids and rows are allowed; null ids count as larger than any other.
    Other columns are dropped; an empty table gives an empty result.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, n))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(distinct, distinct.count(), distance))
    linked = distinct.join(found, distinct["fp"] == found["node"]).select("fp", "least", "root")
    # A component may hold most fingerprints: its rows meet the smallest id in parts.
    least = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    placed = linked.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).join(least, ["root", "part"]).select("fp", "component_id")
    # Stored, so that the last join reads two plain shuffles and Spark can split a
    # fingerprint that very many copies share.
    classes = cut_lineage(distinct.join(placed, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """`docs` without near duplicates: of every component the row with the
    smallest id stays (one of them where an id is repeated). Rows without an id
    cannot be told apart and stay. Columns stay as they are."""
    classes = near_duplicates(docs, id_col, text_col, distance)
    chosen = classes.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__sh_id")).distinct()
    kept = docs.join(chosen, F.col(id_col) == F.col("__sh_id"), "left_semi").dropDuplicates([id_col])
    docs.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
