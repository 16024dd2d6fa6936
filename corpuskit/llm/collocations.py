"""Phrases whose words belong together, mined by stripes.

A stripe is a prefix with an associative counter of the words that follow it. One
pass of tasks makes the stripes of their blocks of text, one a prefix and block;
stripes of a prefix are merged element by element. One merged stripe then gives
three things: the extensions that are frequent, the prefix's total (for the empty
prefix all words, for a word its occurrences, rare followers and ends of pieces
included), and the largest extension, which tells whether the prefix is only part
of a longer phrase. The empty prefix holds the words themselves.

Lengths are mined in turn, and a window is counted only when all shorter windows
in it may be frequent: a part of a frequent phrase is frequent. Which windows may
be is read from a bit map of hashed frequent phrases. It is sized by their number
up to `MAX_BITS`; a false "may be" costs an entry of a stripe, never a count. From
three words on, only the stretches of text made of frequent pairs are read.

A stripe is cut into segments by a hash of the next word, so that a segment holds
a bounded share of the vocabulary however hot its prefix is. Segments are dealt into
buckets by hash; a block sends a compressed row a bucket, and a task merges one
bucket at a time. The number of buckets follows the stored size of the texts.

Null texts count as empty, a null language as `und`. Repeated rows count again;
equal scores are ordered by count and phrase. An empty table gives no phrases.
A long text is worked on as a block of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from corpuskit.llm.arrays import mix, owners, span_hashes, spans, text_slices, utf8
from corpuskit.operators.ranking import union_all
from corpuskit.session import shared_folder

LONGEST = 5  # words of a phrase
MIN_COUNT = 100
BLOCK_BYTES = 1 << 22  # text whose stripes are made at once
SEGMENT_WORDS = 1 << 18  # next words of a segment, about: some 8 MB
STEP_WORDS = 1 << 18  # next words put together before they are merged
BUCKET_BYTES = 1 << 21  # stored texts for each bucket of stripes
PART_BYTES = 1 << 23  # stored texts for each part that merges buckets
MAX_BITS = 1 << 27  # of a bit map of frequent phrases: 16 MB
BITS_EACH = 24  # and two probes: under one in a hundred is a false alarm

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09]] = True

PART = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("segment", pa.int32()), ("rest", pa.int64()), ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])
MERGED = "lang string, prefix string, total long, largest long, next array<string>, n array<long>"


@dataclass(frozen=True)
class MayBeFrequent:
    """Bit map of the hashes of frequent phrases of one length."""

    bits: bytes
    size: int

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.bits, np.uint8)
        first, second = ((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0 for s in slots_of(hashes, self.size))
        return first & second


def slots_of(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return tuple((h & np.uint64(size - 1)).astype(np.int64) for h in (hashes, hashes >> np.uint64(32)))


# -- inside a task ----------------------------------------------------------------


@dataclass
class Block:
    """The words of some texts: language and dictionary code, piece, weight."""

    langs: list[str]
    lang: np.ndarray
    lang_hash: np.ndarray
    dictionary: pa.Array
    code: np.ndarray
    hashes: np.ndarray  # of the dictionary's words
    first: np.ndarray  # whether the word opens a piece
    weight: np.ndarray

    def windows(self, size: int) -> np.ndarray:
        """Which words open a window of `size` words of one piece."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, bool)
        inside = np.ones(n, bool)
        for i in range(1, size):
            inside &= ~self.first[i : n + i]
        return inside

    def hashed(self, at: np.ndarray, size: int) -> np.ndarray:
        return phrase_hashes([self.hashes[self.code[at + i]] for i in range(size)], self.lang_hash[self.lang[at]])


def phrase_hashes(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    out = lang.copy()
    for h in words:
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h)
    return out


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = utf8(words)
    return span_hashes(data, offsets[:-1], offsets[1:])


def _string_hashes(words: list[str]) -> np.ndarray:
    return _hashes(pa.array(words, pa.large_string()))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Words of (lang, text, weight) rows, lower-cased from A to Z."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names = langs.dictionary.to_pylist()
        row_lang = langs.indices.to_numpy(zero_copy_only=False)
        weights = batch.column(2).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in text_slices(batch.column(1), BLOCK_BYTES):
            capital = (data >= 65) & (data <= 90)
            data = data + (capital.view(np.uint8) << 5)
            broken = BREAK[data]
            inside = ~(broken | BLANK[data])
            starts, ends = spans(inside, offsets)
            if not len(starts):
                continue
            row = owners(starts, offsets)
            # A word opens a piece when its text begins or a break lies before it.
            breaks = np.concatenate([[0], np.cumsum(broken, dtype=np.int32)])[starts]
            opens = np.ones(len(starts), bool)
            opens[1:] = (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])
            borders = np.concatenate([[0], np.cumsum(ends - starts)])
            spelled = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(data[inside])])
            coded = spelled.dictionary_encode()
            yield Block(names, row_lang[first + row], _string_hashes(names), coded.dictionary, coded.indices.to_numpy(), _hashes(coded.dictionary), opens, weights[first + row])


def alive(block: Block, size: int, filters: list[MayBeFrequent]) -> np.ndarray:
    """Starts of the windows of `size` words all of whose parts, and themselves,
    may be frequent; `filters` are those of 1 to `size` words."""
    at = np.flatnonzero(filters[0](block.hashed(np.arange(len(block.code)), 1)))
    for n in range(2, size + 1):
        at = _pairs(block, at, n)
        at = at[filters[n - 1](block.hashed(at, n))]
    return at


def _pairs(block: Block, at: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows of `size` words whose two parts of one word less begin in `at`."""
    if not len(at):
        return at
    follows = np.zeros(len(at), bool)
    follows[:-1] = at[1:] == at[:-1] + 1
    at = at[follows]
    return at[block.windows(size)[at]]


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, place of an example of each number)."""
    _, example, which = np.unique(keys, return_index=True, return_inverse=True)
    return which.astype(np.int64), example


def _stripes(block: Block, length: int, filters: list[MayBeFrequent], segments: int) -> pa.RecordBatch | None:
    """Stripes of the prefixes of `length` - 1 words of a block."""
    width = len(block.dictionary)
    every = np.arange(len(block.code))
    starts = alive(block, length - 1, filters) if length > 1 else every
    if not len(starts):
        return None
    # Prefixes, numbered densely.
    which, example = _dense(block.lang[starts].astype(np.int64) * width + (block.code[starts] if length > 1 else 0))
    for i in range(1, length - 1):
        which, example = _dense(which * np.int64(width) + block.code[starts + i])
    prefixes = len(example)
    # A next word counts by itself when the window it closes may be frequent;
    # all other next words and ends of pieces are the stripe's rest.
    counted = np.ones(len(starts), bool)
    if length > 1:
        counted = np.isin(starts, _pairs(block, starts, length), assume_unique=True) if length > 2 else _open_pairs(block, starts)
    weight = block.weight[starts]
    rest = np.bincount(which[~counted], weights=weight[~counted], minlength=prefixes).astype(np.int64)
    following = starts[counted] + length - 1
    segment = (mix(block.hashes[block.code[following]]) & np.uint64(segments - 1)).astype(np.int64)
    key = (which[counted] * segments + segment) * width + block.code[following]
    keys, back = np.unique(key, return_inverse=True)
    n = np.bincount(back, weights=weight[counted], minlength=len(keys)).astype(np.int64)
    cell = keys // width
    # A word with nothing but a rest has a row as well, as its total counts. Longer
    # prefixes were counted as extensions of shorter ones.
    lone = np.setdiff1d(np.flatnonzero(rest > 0), cell[cell % segments == 0] // segments) * segments if length == 2 else np.zeros(0, np.int64)
    cells, begin = np.unique(cell, return_index=True)
    every_cell = np.concatenate([cells, lone])
    sizes = np.concatenate([np.diff(np.append(begin, len(keys))), np.zeros(len(lone), np.int64)])
    holder = every_cell // segments
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    at = starts[example[holder]]
    if length > 1:
        # Words hold no blank, so a blank keeps phrases apart.
        parts = [block.dictionary.take(pa.array(block.code[at + i])) for i in range(length - 1)]
        prefix = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if length > 2 else parts[0]
    else:
        prefix = pa.array([""] * len(at), pa.large_string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.langs, pa.string()).take(pa.array(block.lang[at])),
            prefix.cast(pa.string()),
            pa.array((every_cell % segments).astype(np.int32)),
            pa.array(np.where(every_cell % segments == 0, rest[holder], 0)),
            pa.ListArray.from_arrays(pa.array(ends), block.dictionary.take(pa.array(keys % width)).cast(pa.string())),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(n)),
        ],
        schema=PART,
    )


def _open_pairs(block: Block, starts: np.ndarray) -> np.ndarray:
    """Which frequent words are followed, in their piece, by a frequent word."""
    follows = np.zeros(len(starts), bool)
    follows[:-1] = starts[1:] == starts[:-1] + 1
    after = np.minimum(starts + 1, len(block.code) - 1)
    return follows & ~block.first[after]


def _packed(stripes: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Stripes put together by bucket, compressed: a row a bucket."""
    langs = stripes.column(0).dictionary_encode()
    lang = _string_hashes(langs.dictionary.to_pylist())[langs.indices.to_numpy(zero_copy_only=False)]
    segment = stripes.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
    bucket = (phrase_hashes([_hashes(stripes.column(1)), segment], lang) & np.uint64(buckets - 1)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, stripes = bucket[order], stripes.take(pa.array(order))
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    bodies = [squeeze(stripes.slice(a, z - a).serialize()) for a, z in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), pa.array(bodies, pa.binary())], names=["bucket", "body"])


def _merged(batches: Iterator[pa.RecordBatch], min_count: int, length: int, segments: int) -> Iterator[pa.RecordBatch]:
    """Merges the stripes of each bucket; what is frequent in them, their totals and
    maxima. The rows come sorted by bucket; one bucket's counters are held."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, held, size = None, [], 0
    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            if held and bucket != now:
                yield _frequent(_elementwise(held, segments), min_count, length, segments)
                held, size = [], 0
            now = bucket
            held.append(pa.ipc.read_record_batch(pa.py_buffer(unpack(body.as_py())), PART))
            size += len(held[-1].column(4).flatten())
            if len(held) > 1 and size > STEP_WORDS + 2 * len(held[0].column(4).flatten()):
                held = [_elementwise(held, segments)]
                size = len(held[0].column(4).flatten())
    if held:
        yield _frequent(_elementwise(held, segments), min_count, length, segments)


def _elementwise(parts: list[pa.RecordBatch], segments: int) -> pa.RecordBatch:
    """Stripes of one prefix and segment added up, each a row."""
    batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    lang, prefix = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
    key = (lang.indices.to_numpy().astype(np.int64) * len(prefix.dictionary) + prefix.indices.to_numpy()) * segments + batch.column(2).to_numpy()
    unit, example = _dense(key)
    units = len(example)
    lists = batch.column(4)
    lengths = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    keys, back = np.unique(np.repeat(unit, lengths) * np.int64(width) + coded.indices.to_numpy(), return_inverse=True)
    n, rest = np.zeros(len(keys), np.int64), np.zeros(units, np.int64)
    np.add.at(n, back, batch.column(5).flatten().to_numpy())
    np.add.at(rest, unit, batch.column(3).to_numpy())
    ends = np.searchsorted(keys, np.arange(units + 1) * np.int64(width)).astype(np.int32)
    at = pa.array(example)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(rest),
            pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(keys % width))),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(n)),
        ],
        schema=PART,
    )


def _frequent(rows: pa.RecordBatch, min_count: int, length: int, segments: int) -> pa.RecordBatch:
    lists, numbers = rows.column(4), rows.column(5)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    n = numbers.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    running = np.concatenate([[0], np.cumsum(n)])
    total = rows.column(3).to_numpy(zero_copy_only=False) + running[ends[1:]] - running[ends[:-1]]
    largest = np.zeros(len(lengths), np.int64)
    np.maximum.at(largest, np.repeat(np.arange(len(lengths)), lengths), n)
    keep = n >= min_count
    # Prefixes that only seemed to be frequent go, and longer ones without extensions.
    real = largest >= min_count if length > 2 else (total >= min_count) | (segments > 1) | (length == 1)
    if not real.all():
        return _frequent(rows.filter(pa.array(real)), min_count, length, segments)
    kept = np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0), rows.column(1), pa.array(total), pa.array(largest),
            pa.ListArray.from_arrays(pa.array(kept), lists.flatten().filter(pa.array(keep))),
            pa.ListArray.from_arrays(pa.array(kept), pa.array(n[keep])),
        ],
        names=["lang", "prefix", "total", "largest", "next", "n"],
    )


# -- over the corpus --------------------------------------------------------------


def _level(docs: DataFrame, texts: DataFrame, length: int, filters: list[MayBeFrequent], segments: int, min_count: int) -> DataFrame:
    """Merged stripes of the prefixes of `length` - 1 words. A segment is a row."""
    held = texts.sparkSession.sparkContext.broadcast(filters)

    # The stored size sets into how many buckets stripes are dealt.
    size = _stored_bytes(docs)
    buckets = min(max(_power_of_two(size / BUCKET_BYTES), 64), 1 << 20)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = _stripes(block, length, held.value, segments)
            if out is not None and out.num_rows:
                yield _packed(out, buckets)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merged(batches, min_count, length, segments)

    made = texts.mapInArrow(make, "bucket int, body binary")
    parts = min(buckets, size // PART_BYTES)
    usual = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = made.repartition(parts, "bucket") if parts > usual else made.repartition("bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(merge, MERGED)


def _runs(texts: DataFrame, filters: list[MayBeFrequent]) -> DataFrame:
    """Stretches of words all of whose pairs may be frequent, with how often each
    occurs in its block: all that phrases of three words or more are made of."""
    held = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            at = alive(block, 2, held.value)
            if not len(at):
                continue
            breaks = np.flatnonzero(at[1:] != at[:-1] + 1)
            first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + 2
            first, last = first[last - first > 2], last[last - first > 2]
            if not len(first):
                continue
            sizes = last - first
            ends = np.concatenate([[0], np.cumsum(sizes)])
            chosen = np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])
            lists = pa.LargeListArray.from_arrays(pa.array(ends), block.dictionary.take(pa.array(block.code[chosen])))
            coded = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).dictionary_encode()
            width = len(coded.dictionary)
            keys, back = np.unique(block.lang[first].astype(np.int64) * width + coded.indices.to_numpy().astype(np.int64), return_inverse=True)
            n = np.bincount(back, weights=block.weight[first], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.langs, pa.string()).take(pa.array(keys // width)), coded.dictionary.take(pa.array(keys % width)).cast(pa.string()), pa.array(n)],
                names=["lang", "text", "weight"],
            )

    return texts.mapInArrow(run, "lang string, text string, weight long")


def _may_be_frequent(phrases: DataFrame, count: int) -> MayBeFrequent:
    """Bit map of (lang, phrase) rows; made of pieces of 4 KB that Spark merges."""
    size = min(max(1 << (max(count, 1) * BITS_EACH - 1).bit_length(), 1 << 15), MAX_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for first, last, data, offsets in text_slices(batch.column(1), BLOCK_BYTES):
                starts, ends = spans(data != 0x20, offsets)
                words = span_hashes(data, starts, ends).reshape(last - first, -1)
                lang = _string_hashes(langs.dictionary.to_pylist())[langs.indices[first:last].to_numpy(zero_copy_only=False)]
                hashes = phrase_hashes([words[:, i] for i in range(words.shape[1])], lang)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots_of(hashes, size)))], names=["slot"])

    # Spark's bucket numbers begin at 1, its positions at 0; a slot counts from 1.
    slot = F.col("slot") + 1
    pieces = (
        phrases.select("lang", "phrase").mapInArrow(run, "slot long")
        .groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    )
    bits = bytearray(size // 8)
    for row in pieces.toLocalIterator():  # at most MAX_BITS in all
        begin = (row["piece"] - 1) * 4096
        bits[begin : begin + 4096] = row["bits"]
    return MayBeFrequent(bytes(bits), size)


def _stored_bytes(df: DataFrame) -> int:
    """The plan's estimate: the files' size, for a table that is read; 0 where Spark
    knows none and says more than any store holds. It never changes a result, only
    how finely work is cut."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def _power_of_two(x: float) -> int:
    return 1 << max(int(x) - 1, 0).bit_length()


def mine(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(level, lang, prefix, total, largest, next, n): the merged stripes, a row a
    segment, of the prefixes of `level` - 1 words that may be frequent.

    `next` and `n` are the words that follow in `min_count` places or more, and in
    how many. `total` adds up over segments to the prefix's occurrences (up to one
    word; for longer prefixes only to those that may go on to a frequent phrase),
    and `largest` is the largest counter, exact from `min_count` on. Stored in the
    shared folder, as the levels are read several times.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    weighed = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), F.lit(1).cast("long").alias("weight"))
    texts = weighed.where(F.col("text").isNotNull())
    # Into how many segments the empty prefix's stripe is cut.
    segments = min(max(_power_of_two(_stored_bytes(docs) / (64 << 20)), 64), 1 << 16)
    filters: list[MayBeFrequent] = []
    for length in range(1, longest + 1):
        if length == 3:
            _runs(texts, filters).write.parquet(f"{folder}/runs")
            texts = spark.read.parquet(f"{folder}/runs")
        _level(docs, texts, length, filters, segments, min_count).write.parquet(f"{folder}/level={length}")
        if length < longest:
            found = extensions(spark.read.parquet(f"{folder}/level={length}"))
            count = found.count()
            filters.append(_may_be_frequent(found, count))
            if length == 1:
                segments = _power_of_two(count / SEGMENT_WORDS)
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/level={i}" for i in range(1, longest + 1)])


def extensions(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, a): every frequent phrase with its count."""
    pairs = stripes.where(F.size("next") > 0).select("lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.next")).otherwise(F.concat_ws(" ", "prefix", "e.next"))
    return pairs.select("lang", phrase.alias("phrase"), F.col("e.n").alias("a"))


def scored(stripes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the frequent phrases of two words or more
    that are not only a part of a longer one as frequent. The score is
    floor(1000 a n / (l r)) at the cut into two parts where it is lowest (then the
    shortest first part), in whole numbers of 38 digits."""
    words = F.split("phrase", " ")

    def part(begin, length):
        return F.array_join(F.slice(words, begin, length), " ")

    # A word's count is the total of its stripe, that of a longer part the counter of
    # its last word in the stripe of the words before.
    prefixes = stripes.groupBy("level", "lang", "prefix").agg(F.sum("total").alias("total"), F.max("largest").alias("largest"))
    counts = union_all([prefixes.where("level = 2").select("lang", F.col("prefix").alias("phrase"), F.col("total").alias("a")), extensions(stripes.where("level > 1"))])
    several = extensions(stripes.where("level > 1"))
    # A longer phrase hides a part of it that is nowhere else. Such a part has an
    # extension by one word that is as frequent, to the right (its stripe's largest
    # counter) or to the left (the phrases that end in it).
    endings = several.groupBy("lang", part(F.lit(2), F.size(words)).alias("phrase")).agg(F.max("a").alias("before"))
    right = prefixes.select("lang", F.col("prefix").alias("phrase"), F.col("largest").alias("after"))
    wanted = several.join(endings, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left").where(
        (F.coalesce("before", F.lit(0)) < F.col("a")) & (F.coalesce("after", F.lit(0)) < F.col("a"))
    )
    cuts = wanted.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")).select(
        "*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size(words)).alias("right")
    )
    measured = (
        cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
        .join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
        .join(prefixes.where("level = 1").select("lang", F.col("total").alias("n")), "lang")
    )
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = measured.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return least.select("lang", "phrase", *[F.col(f"cut.{c}") for c in ("a", "l", "r", "n", "score")])


def collocations(docs: DataFrame, top: int, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases
    by score, then count, both from the highest, then phrase in byte order."""
    found = scored(mine(docs, lang_col, text_col, longest, min_count))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
