"""Cross-entropy difference of two n-gram models.

A target model and a background model of word pairs share one vocabulary and one
smoothing; the score of a document is the mean over its words of target minus
background log probability, so a document like the target texts scores above
zero. The background's smoothing mass is scaled by the ratio of the models'
sizes: at equal relative frequencies both give equal losses.

Words, histories and pairs are all counted, each under a 62-bit key of its own;
the counts grow with the corpus and stay in Spark. Texts are dealt into blocks of
about `BLOCK_BYTES`. A block gives each of its distinct keys once, however hot it
is, as rows of one range of keys each: sorted keys as compressed differences, with
their counts. A range of all blocks is merged by sorting, and each block gets the
sums of its own keys back, in their order, without the keys. A task holds one block
or one range. A document does not vouch for itself: its own counts are taken out of
the models before it is scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from corpuskit.llm.arrays import SPACE, mix, slices, span_hashes, spans, sums, utf8
from corpuskit.session import shared_folder

BLOCK_BYTES = 1 << 24
RANGE_BYTES = 1 << 25  # text whose keys make one range
MASS = 20.0  # smoothing words added to each history
START = 0  # the word before a text's first
PAIR, WORD = range(2)  # the lowest bit of a key; histories are counted beside words

IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words (letters and digits, as they are written) and of the runs
    of other signs between them."""
    inside, blank = IN_WORD[data], SPACE[data]
    starts, ends = spans(inside, offsets)
    others, stops = spans(~inside & ~blank, offsets)
    starts, ends = np.concatenate([starts, others]), np.concatenate([ends, stops])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body): texts compressed one by one, an empty text for null."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in slices(offsets):
                bodies = [squeeze(data[a:b].tobytes()) for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(bodies, pa.binary())], names=["id", "body"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, body binary")


def in_blocks(texts: DataFrame, block_bytes: int) -> DataFrame:
    """(block, ids, targets, sizes, body): pieces of about a megabyte of texts, joined
    and compressed. Texts that begin in the same `block_bytes` of a task share a
    block. Block numbers are random, so the result is to be stored."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        seed, read = np.uint64(uuid.uuid4().int >> 64), 0
        for batch in batches:
            sizes = np.array([zstandard.frame_content_size(x.as_py()) for x in batch.column(2)], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            number = (read + offsets[:-1]) // block_bytes
            read += int(offsets[-1])
            borders = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1, [len(number)]]) if len(number) else np.zeros(1, np.int64)
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                block = mix(number[a : a + 1].astype(np.uint64) + seed).view(np.int64)
                for first, last in slices(offsets[a : b + 1]):
                    part, ends = slice(a + first, a + last), pa.array([0, last - first], pa.int32())
                    lists = [
                        pa.ListArray.from_arrays(ends, values)
                        for values in (batch.column(0)[part], batch.column(1)[part], pa.array(sizes[part]))
                    ]
                    body = squeeze(b"".join(unpack(x.as_py()) for x in batch.column(2)[part]))
                    yield pa.RecordBatch.from_arrays([pa.array(block), *lists, pa.array([body], pa.binary())], names=["block", "ids", "targets", "sizes", "body"])

    return texts.select("id", "target", "body").mapInArrow(
        run, f"block long, ids array<{kind}>, targets array<boolean>, sizes array<long>, body binary"
    )


def _opened(targets, sizes, body) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(target flags, bytes, offsets from 0) of each stored piece."""
    unpack = zstandard.ZstdDecompressor().decompress
    for flags, lengths, packed_texts in zip(targets, sizes, body):
        offsets = np.concatenate([[0], np.cumsum(lengths.values.to_numpy())])
        yield flags.values.to_numpy(zero_copy_only=False), np.frombuffer(unpack(packed_texts.as_py()), np.uint8), offsets


def keyed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, pair keys, word keys, keys of the words before) of every word."""
    starts, ends = tokens(data, offsets)
    words = (span_hashes(data, starts, ends) & ~np.uint64(3)) | np.uint64(WORD)
    borders = np.searchsorted(starts, offsets)
    counts = np.diff(borders)
    history = np.empty_like(words)
    history[1:] = words[:-1]
    history[borders[:-1][counts > 0]] = START
    pairs = mix(history * np.uint64(0xC2B2AE3D27D4EB4F) + words)
    return counts, (pairs & ~np.uint64(3)) | np.uint64(PAIR), words, history


def packed_numbers(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes that hold the largest, the bytes of
    one place together, compressed."""
    width = max((int(values.max(initial=0)).bit_length() + 7) // 8, 1)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked_numbers(body: bytes) -> np.ndarray:
    width = body[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return packed_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(body: bytes) -> np.ndarray:
    return np.cumsum(unpacked_numbers(body), dtype=np.uint64)


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the place of each key among them, by one sort."""
    return np.unique(keys, return_inverse=True)


def _placed_words(words: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`_placed` of the words and of the words before them, which are `START` or the
    last word: that is the smallest key, so one sort places both."""
    known, place = _placed(words)
    if not len(words):
        return known, place, place
    place += 1
    before = np.roll(place, 1)
    before[history == START] = 0
    return np.concatenate([np.array([START], np.uint64), known]), place, before


def counted(stored: DataFrame, bits: int) -> DataFrame:
    """(range, block, kind, keys, counts): the distinct keys of a block whose upper
    `bits` bits are the range's number, and their packed counts: (background, target)
    of pairs, (background, target, background before a word, target before a word) of
    words. All texts are background, target texts too. A block that two tasks read
    has rows from both."""

    def given(block: int, parts: list) -> Iterator[pa.RecordBatch]:
        pairs, words, history, flags = (np.concatenate([p[i] for p in parts]) for i in range(4))
        for kind, (known, *places) in ((PAIR, _placed(pairs)), (WORD, _placed_words(words, history))):
            n = [np.bincount(some, minlength=len(known)) for place in places for some in (place, place[flags])]
            cuts = np.searchsorted(known, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)
            borders = np.concatenate([[0], cuts, [len(known)]]).tolist()
            for number, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
                if a < b:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number]), pa.array([block]), pa.array([kind]), pa.array([packed_keys(known[a:b])], pa.binary()),
                            pa.array([[packed_numbers(x[a:b]) for x in n]], pa.list_(pa.binary())),
                        ],
                        names=["range", "block", "kind", "keys", "counts"],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for block, (flags, data, offsets) in zip(batch.column(0).to_pylist(), _opened(*batch.columns[1:])):
                if parts and block != now:
                    yield from given(now, parts)
                    parts = []
                now = block
                counts, *keys = keyed(data, offsets)
                parts.append((*keys, np.repeat(flags, counts)))
        if parts:
            yield from given(now, parts)

    return stored.select("block", "targets", "sizes", "body").mapInArrow(
        run, "range long, block long, kind long, keys binary, counts array<binary>"
    )


def summed(rows: DataFrame) -> DataFrame:
    """(block, range, kind, counts, words, background, target): for each block the
    sums over all blocks of its keys of a range, in their order. The first row of a
    range also has its distinct words and their sums, others have 0."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        blocks, kinds = table.column("block").to_numpy(), table.column("kind").to_numpy()
        for kind in (PAIR, WORD):
            at = np.flatnonzero(kinds == kind)
            if not len(at):
                continue
            each = [unpacked_keys(table.column("keys")[i].as_py()) for i in at.tolist()]
            known, which = np.unique(np.concatenate(each), return_inverse=True)
            which = which.astype(np.int32)
            n = []
            for side in range(2 if kind == PAIR else 4):
                values = np.concatenate([unpacked_numbers(table.column("counts")[i][side].as_py()) for i in at.tolist()])
                n.append(np.bincount(which, weights=values, minlength=len(known)).astype(np.int64))
            places = dict()
            for i, found in zip(at.tolist(), np.split(which, np.cumsum([len(x) for x in each])[:-1])):
                places.setdefault(int(blocks[i]), []).append(found)
            facts = [int((n[0] > 0).sum()), int(n[0].sum()), int(n[1].sum())] if kind == WORD else [0, 0, 0]
            for block, found in places.items():
                place = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
                out.append((block, kind, [packed_numbers(x[place]) for x in n], *facts))
                facts = [0, 0, 0]
        columns = list(zip(*out))
        return pa.Table.from_arrays(
            [
                pa.array(columns[0], pa.int64()), pa.array([table.column("range")[0].as_py()] * len(out), pa.int64()), pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.list_(pa.binary())), *(pa.array(c, pa.int64()) for c in columns[3:]),
            ],
            names=["block", "range", "kind", "counts", "words", "background", "target"],
        )

    return rows.groupBy("range").applyInArrow(
        run, "block long, range long, kind long, counts array<binary>, words long, background long, target long"
    )


def _log_losses(counts: np.ndarray, target: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray, width: float) -> np.ndarray:
    """Log probability of each word under (background, target), the document's own
    counts taken out. `found` holds (number, counts in the models) of each word's
    pair, itself and the word before; `total` the words of the models, `width` their
    distinct words and one."""
    owner = np.repeat(np.arange(len(counts)), counts)
    taken = np.stack([np.ones(len(owner)), target[owner].astype(float)], axis=1)

    def others(values: np.ndarray, n: np.ndarray) -> np.ndarray:
        _, which, own = np.unique(owner * (int(values.max(initial=0)) + 1) + values, return_inverse=True, return_counts=True)
        return n - taken * own[which][:, None]

    size = np.maximum(total - taken * counts[owner][:, None], 1.0)
    mass = MASS * np.array([max(total[0] / max(total[1], 1.0), 1.0), 1.0])
    pair, word, before = (others(values, n) for values, n in found)
    alone = (np.maximum(word, 0) + mass) / (size + mass * width)
    pair = np.maximum(pair, 0)
    return np.log((pair + mass * alone) / (np.maximum(before, pair) + mass))


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(id, n_words, target_loss, background_loss, score): mean losses per word and
    background minus target loss, for every row. `targets` holds the ids of the
    target rows, under the same name; it may grow with the corpus, so it meets the
    documents in a sort-merge join of ids and compressed texts.

    A text without words (null, empty) has losses and score 0. Repeated rows count
    and are scored each. Other columns are dropped; an empty table gives no rows.
    Without target rows the target model is uniform. A text longer than `block_bytes`
    is a block with what begins beside it, in one task's memory.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    folder = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    named = targets.select(F.col(id_col).alias("id"), F.lit(True).alias("target")).distinct().hint("merge")
    joined = packed(docs, id_col, text_col).join(named, "id", "left").select("id", F.coalesce("target", F.lit(False)).alias("target"), "body")
    in_blocks(joined, block_bytes).write.option("compression", "none").parquet(f"{folder}/texts")
    stored = spark.read.parquet(f"{folder}/texts")
    size = stored.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    bits = (int(size) // range_bytes).bit_length()
    summed(counted(stored, bits)).write.option("compression", "none").parquet(f"{folder}/counts")
    answers = spark.read.parquet(f"{folder}/counts")
    facts = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "background", "target"))).first()
    total, width = np.array([facts[1], facts[2]], float), float(facts[0] + 1)

    def run(texts: pa.Table, sums_: pa.Table) -> pa.Table:
        pieces, read = texts.column("ids"), []
        for flags, data, offsets in _opened(texts.column("targets"), texts.column("sizes"), texts.column("body")):
            read.append((flags, *keyed(data, offsets)))
        models = []
        for number, own in ((PAIR, 1), (WORD, 2)):
            rows = sorted((r, i) for i, (r, k) in enumerate(zip(sums_.column("range").to_pylist(), sums_.column("kind").to_pylist())) if k == number)
            models.append([
                np.concatenate([unpacked_numbers(sums_.column("counts")[i][side].as_py()) for _, i in rows] or [np.zeros(0, np.uint64)]).astype(float)
                for side in range(2 * own)
            ])
        (pair_n, word_n), ids = models, [x.values for x in pieces]
        # The places of a block's words among its keys are those that `counted` gave.
        pairs, words, history = (np.concatenate([np.zeros(0, np.uint64), *(r[i] for r in read)]) for i in (2, 3, 4))
        read = [r[:2] for r in read]
        places = [_placed(pairs)[1], *_placed_words(words, history)[1:]]
        del pairs, words, history
        sizes, means, first = [np.zeros(0, np.int64)], [np.zeros((0, 2))], 0
        for flags, counts in read:
            last = first + int(counts.sum())
            pair, word, before = (x[first:last] for x in places)
            first = last
            found = [(place, np.stack([side[place] for side in n], axis=1)) for place, n in ((pair, pair_n), (word, word_n[:2]), (before, word_n[2:]))]
            each = _log_losses(counts, flags, found, total, width)
            sizes.append(counts)
            means.append(-sums(each, counts) / np.maximum(counts, 1)[:, None])
        mean = np.concatenate(means)
        return pa.Table.from_arrays(
            [
                pa.chunked_array(ids, texts.schema.field("ids").type.value_type), pa.array(np.concatenate(sizes)),
                pa.array(mean[:, 1]), pa.array(mean[:, 0]), pa.array(mean[:, 0] - mean[:, 1]),
            ],
            names=[id_col, "n_words", "target_loss", "background_loss", "score"],
        )

    return stored.groupBy("block").cogroup(answers.select("block", "range", "kind", "counts").groupBy("block")).applyInArrow(
        run, f"`{id_col}` {kind}, n_words long, target_loss double, background_loss double, score double"
    )
