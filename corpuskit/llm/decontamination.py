"""Benchmark decontamination: n-gram seeds find passages of training texts that
may copy a test item, and Smith-Waterman alignment of words scores them.

1. The distinct n-grams of the items are counted in the texts. One that at most
   `RARE_SHARE` of the texts have is rare, and meets its item alone. So does any
   n-gram of an item of at most `SHORT` words: it is most of a match already. Items
   of fewer than n words are looked for by their whole word sequence.
2. Common n-grams count two at a time, in the order of an item: a text and an item
   that share only "one of the" do not meet, a hot edited copy does.
   Words around such seeds are cut out of the texts as passages, which are joined to
   items by all n-grams of the passage: one rare or two different ones.
3. Each passage is aligned with each item it met. An edited copy keeps a high
   score, since changed, lost and added words only cost a little.

What is not found is an alignment whose only run of n words is a common one.

The tasks that read texts get bit maps of the hashes, at most 2^`MAP_BITS` bits each,
not the n-grams themselves; the joins after it are exact. The maps are sparse and
travel compressed: a worker holds one unpacked copy of each. Only passages move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from corpuskit.llm.arrays import gram_hashes, mix, owners, repeated, span_hashes, spans, text_slices
from corpuskit.session import cut_lineage

N = 3
MIN_SCORE = 0.5
MIN_MATCH = 13  # matching words that make a copy of a part, whatever the item's length
RARE_SHARE = 0.001
SHORT = 9  # words of an item that a single run of n words may match
PAIR_WORDS = 64  # between two seeds of an item; in a text half as much again
MAP_BITS = 28
MATCH, MISMATCH, GAP = 2, -1, -1
PART_WORDS = 2048  # an alignment's texts are cut to parts of this many words, overlapping

IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lowered(column) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, hashes, rows) of runs of letters and digits."""
    starts, ends = spans(IN_WORD[data], offsets)
    return starts, ends, span_hashes(data, starts, ends), owners(starts, offsets)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int):
    """(first word, hash) of the n-grams that lie in one row."""
    h = gram_hashes(hashes, n)
    at = np.flatnonzero(rows[: len(h)] == rows[n - 1 :]) if len(h) else np.zeros(0, np.int64)
    return at, h[at]


def text_grams(hashes: np.ndarray, rows: np.ndarray, lengths: list[int]):
    """(first word, words, hash) of the grams of all these lengths, in order."""
    found = [grams(hashes, rows, n) for n in lengths]
    at, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    long = np.repeat(np.array(lengths, np.int64), [len(f[0]) for f in found])
    order = np.argsort(at, kind="stable")
    return at[order], long[order], h[order]


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, gram, words): the distinct n-grams of each item; of a shorter one,
    its whole word sequence."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(lowered(batch.column(1))):
                _, _, hashes, rows = word_hashes(data, offsets)
                size = np.bincount(rows, minlength=last - first)
                at, long, h = text_grams(hashes, rows, list(range(1, n + 1)))
                own = long == np.minimum(size[rows[at]], n)
                at, h = at[own], h[own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[at] + first)), pa.array(h.view(np.int64)), pa.array(size[rows[at]])], names=["item_id", "gram", "words"]
                )

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, gram long, words long").distinct()


def item_pairs(items: DataFrame, n: int) -> DataFrame:
    """(gram): keys of two different n-grams of an item of more than `SHORT` words, in
    order and at most `PAIR_WORDS` apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(lowered(batch.column(0))):
                _, _, hashes, rows = word_hashes(data, offsets)
                at, h = grams(hashes, rows, n)
                long = (np.bincount(rows, minlength=last - first) > SHORT)[rows[at]]
                at, h = at[long], h[long]
                for a, b in pairs_within(at, rows[at], PAIR_WORDS):
                    some = np.unique(pair_keys(h[a], h[b])[h[a] != h[b]])
                    yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], names=["gram"])

    return items.select("text").mapInArrow(run, "gram long").distinct()


def pairs_within(at: np.ndarray, rows: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(earlier, later) numbers of seeds of one row that are at most so many words
    apart, by how many seeds apart they are. `at` is in order."""
    here = np.arange(len(at))
    for lag in range(1, len(at)):
        here = here[: np.searchsorted(here, len(at) - lag)]
        here = here[(rows[here] == rows[here + lag]) & (at[here + lag] - at[here] <= words)]
        if not len(here):
            return
        yield here, here + lag


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xC2B2AE3D27D4EB4F) + second)


def counted_grams(docs: DataFrame, wanted: DataFrame, lengths: list[int]) -> DataFrame:
    """(gram, texts): in how many texts each wanted n-gram stands."""
    packed_map, bits = bit_map(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _unpacked(packed_map)
        for batch in batches:
            for _, _, data, offsets in text_slices(lowered(batch.column(0))):
                _, _, hashes, rows = word_hashes(data, offsets)
                at, _, h = text_grams(hashes, rows, lengths)
                hit = _in_map(h, packed, bits)
                again, _ = repeated(rows[at[hit]], h[hit])
                found, n = np.unique(h[hit][~again], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "texts"])

    return docs.select("text").mapInArrow(run, "gram long, texts long").groupBy("gram").agg(F.sum("texts").alias("texts"))


def bit_map(gram_table: DataFrame) -> tuple[bytes, int]:
    """(compressed map, bits): a bit for every value of the lowest `bits` bits that a gram has, 256
    slots or more a gram as long as these are at most 2^`MAP_BITS` (32 MB); more grams
    only give more false hits, which the joins remove."""
    bits = min(max((256 * gram_table.count()).bit_length(), 15), MAP_BITS)
    low = F.col("gram").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # buckets are numbered from 1
    pages = gram_table.groupBy(F.bitmap_bucket_number(low).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits"))
    out = np.zeros(((1 << bits) >> 15, 4096), np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(out), bits


def _unpacked(packed_map: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed_map), np.uint8)


def _in_map(h: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    low = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (packed[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0


def passages(docs: DataFrame, gram_table: DataFrame, alone: DataFrame, pairs: DataFrame, lengths: list[int], reach: int) -> DataFrame:
    """(row, id, at, passage, grams): stretches of texts around seeds: grams of
    `alone`, or two that make a key of `pairs`; `grams` are all of `gram_table`. Seeds less
    than `reach` words apart share a stretch, which goes on for `reach` words to
    both sides; `at` is its first word's number. A long stretch is cut to parts
    that overlap by more than an item."""
    maps = [bit_map(t) for t in (gram_table, alone, pairs)]
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, single, double = ((_unpacked(packed), bits) for packed, bits in maps)
        for batch in batches:
            for first, last, data, offsets in text_slices(lowered(batch.column(2))):
                starts, ends, hashes, rows = word_hashes(data, offsets)
                all_at, all_long, all_h = text_grams(hashes, rows, lengths)
                hit = _in_map(all_h, *every)
                all_at, all_long, all_h = all_at[hit], all_long[hit], all_h[hit]
                seed = _in_map(all_h, *single)
                for a, b in pairs_within(all_at, rows[all_at], PAIR_WORDS * 3 // 2):
                    met = (all_h[a] != all_h[b]) & _in_map(pair_keys(all_h[a], all_h[b]), *double)
                    seed[a[met]] = seed[b[met]] = True
                at, long = all_at[seed], all_long[seed]
                if not len(at):
                    continue
                bounds = np.searchsorted(rows, np.arange(last - first + 1))
                fresh = np.ones(len(at), bool)
                # A part ends after PART_WORDS even where seeds go on.
                fresh[1:] = (rows[at[1:]] != rows[at[:-1]]) | (at[1:] - at[:-1] > reach)
                part = (at - np.maximum.accumulate(np.where(fresh, at, 0))) // PART_WORDS
                fresh[1:] |= part[1:] != part[:-1]
                begin = np.flatnonzero(fresh)
                stop = np.append(begin[1:], len(at))
                row = rows[at[begin]]
                low = np.maximum(at[begin] - reach, bounds[row])
                high = np.minimum(at[stop - 1] + long[stop - 1] + reach, bounds[row + 1])
                body = data.tobytes()
                texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[low].tolist(), ends[high - 1].tolist())]
                inside = [all_h[a:b] for a, b in zip(np.searchsorted(all_at, low).tolist(), np.searchsorted(all_at, high).tolist())]
                borders = np.concatenate([[0], np.cumsum([len(x) for x in inside])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(inside).view(np.int64)))
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(low - bounds[row]), pa.array(texts, pa.string()), lists],
                    names=["row", "id", "at", "passage", "grams"],
                )

    return docs.select("row", "id", "text").mapInArrow(run, f"row long, id {kind}, at long, passage string, grams array<long>")


def align(passage: list[np.ndarray], item: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of pairs of word-hash sequences, all pairs at once: (score,
    first word, last word + 1) of the best local alignment in each passage. Of
    equal scores the one that ends first, then the shortest, counts."""
    count = len(passage)
    wide, long = max(map(len, passage), default=0), max(map(len, item), default=0)
    if not count or not wide or not long:
        return np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    p = np.zeros((count, wide), np.uint64)
    q = np.zeros((count, long), np.uint64)
    live = np.zeros((count, wide), bool)
    used = np.zeros((count, long), bool)
    for i, (a, b) in enumerate(zip(passage, item)):
        p[i, : len(a)], live[i, : len(a)] = a, True
        q[i, : len(b)], used[i, : len(b)] = b, True
    # A cell is score * unit + start of its alignment: maxima keep both.
    unit = np.int64(1) << np.int64(max(wide + 1, 2).bit_length())
    fresh = np.arange(1, wide + 1, dtype=np.int64)
    slope = -GAP * unit * np.arange(wide, dtype=np.int64)
    before = np.broadcast_to(fresh, (count, wide)).copy()
    left = np.empty_like(before)
    best = np.zeros(count, np.int64)
    stop = np.zeros(count, np.int64)
    for k in range(long):
        left[:, 0], left[:, 1:] = 0, before[:, :-1]
        now = left + np.where((p == q[:, k, None]) & live, MATCH, MISMATCH) * unit
        np.maximum(now, before + GAP * unit, out=now)
        np.maximum(now, fresh, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        np.maximum(now, fresh, out=now)
        now = np.where(used[:, k, None], now, before)
        at = np.argmax(now // unit, axis=1)
        value = now[np.arange(count), at]
        better = (value // unit > best // unit) & used[:, k]
        best, stop = np.where(better, value, best), np.where(better, at + 1, stop)
        before = now
    return best // unit, best % unit, stop


def scored(pairs: DataFrame, id_kind: str, item_kind: str) -> DataFrame:
    """(row, id, item_id, score, matched, first_word, last_word) of pairs (row, id,
    at, passage, item_id, item). The score is the alignment's over a whole match's,
    `matched` the alignment's in matching words."""

    def split(column) -> list[np.ndarray]:
        out = []
        for first, last, data, offsets in text_slices(lowered(column)):
            _, _, hashes, rows = word_hashes(data, offsets)
            out += np.split(hashes, np.searchsorted(rows, np.arange(1, last - first)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2).to_numpy()
            passage, item = split(batch.column(3)), split(batch.column(5))
            order = np.lexsort(([len(x) for x in item], [len(x) for x in passage]))
            score, start, stop = (np.zeros(len(order), np.int64) for _ in range(3))
            a = 0
            while a < len(order):
                width = max(len(passage[order[min(a + 127, len(order) - 1)]]), 1)
                some = order[a : a + max(1, min(128, 200_000 // width))]
                score[some], start[some], stop[some] = align([passage[i] for i in some], [item[i] for i in some])
                a += len(some)
            whole = np.maximum([MATCH * len(x) for x in item], 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), pa.array(score / whole), pa.array(score / MATCH), pa.array(places + start), pa.array(places + stop)],
                names=["row", "id", "item_id", "score", "matched", "first_word", "last_word"],
            )

    return pairs.select("row", "id", "at", "passage", "item_id", "item").mapInArrow(
        run, f"row long, id {id_kind}, item_id {item_kind}, score double, matched double, first_word long, last_word long"
    )


def meetings(own: DataFrame, tests: DataFrame, wanted: DataFrame, lengths: list[int], reach: int, n: int, rare_share: float) -> DataFrame:
    """(row, id, at, passage, item_id, item): the passages and items to be aligned."""
    grams_of = cut_lineage(
        wanted.join(counted_grams(own, wanted.select("gram").distinct(), lengths), "gram")
        .withColumn("alone", (F.col("texts") <= rare_share * own.count()) | (F.col("words") <= SHORT))
    )
    each = grams_of.select("gram").distinct()
    found = cut_lineage(passages(own, each, grams_of.where("alone").select("gram").distinct(), cut_lineage(item_pairs(tests, n)), lengths, reach))
    once = found.select("row", "id", "at", "passage").dropDuplicates(["row", "at"])
    met = (
        found.select("row", "at", F.explode(F.array_distinct("grams")).alias("gram")).join(grams_of, "gram")
        .groupBy("row", "at", "item_id").agg(F.max("alone").alias("alone"), (F.min("gram") != F.max("gram")).alias("two")).where("alone or two")
    )
    named = tests.select(F.col("item_id").alias("_item"), F.col("text").alias("item"))
    return met.select("row", "at", "item_id").join(once, ["row", "at"]).join(
        named, F.col("item_id").eqNullSafe(F.col("_item"))
    ).drop("_item")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = N, min_score: float = MIN_SCORE, min_match: int = MIN_MATCH, rare_share: float = RARE_SHARE) -> DataFrame:
    """(row, id, item_id, score, first_word, last_word): the best alignment of each
    text with each item that it copies at `min_score` or more, or in a part whose
    alignment is worth `min_match` matching words (errors taken off). `row` is a hash of
    id and text; words are numbered from 0, `last_word` is exclusive.

    Case and everything but letters and digits are ignored. Null and empty texts
    match nothing; items of fewer than `n` words are found where all their words
    stand in order; repeated rows give one result; repeated items one each per item id, of which null is one.
    Other columns are dropped. An empty table on either side gives no rows.
    """
    own = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    id_kind, item_kind = own.schema["id"].dataType.simpleString(), tests.schema["item_id"].dataType.simpleString()
    wanted = cut_lineage(item_grams(tests, n))
    reach = wanted.agg(F.max("words")).first()[0]
    if reach is None:
        return docs.sparkSession.createDataFrame([], f"row long, id {id_kind}, item_id {item_kind}, score double, first_word long, last_word long")
    lengths = sorted(r[0] for r in wanted.select(F.least("words", F.lit(n)).cast("int")).distinct().collect())  # at most n
    pairs = meetings(own, tests, wanted, lengths, int(reach), n, rare_share)
    kept = scored(pairs, id_kind, item_kind).where((F.col("score") >= min_score) | (F.col("matched") >= min_match)).drop("matched")
    best = F.row_number().over(Window.partitionBy("row", "item_id").orderBy(F.desc("score"), "first_word", "last_word"))
    return kept.withColumn("_rank", best).where("_rank = 1").drop("_rank")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows whose text copies an item. Columns stay."""
    bad = matches(docs, items, id_col, text_col, **options).select("row").distinct()
    return docs.join(bad, F.xxhash64(id_col, text_col) == bad["row"], "left_anti")
