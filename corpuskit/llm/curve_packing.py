"""Packing along a space-filling curve: documents that use like tokens stand next
to each other and share training sequences.

Token counts of a document are hashed to a vector, projected to few dimensions,
cut to a grid and numbered by the Hilbert curve. Documents are range-sorted by
that key, with a hash of the id behind it so that many equal documents spread
over tasks, and laid end to end in each range. A sequence is full at `size`
tokens; what is left at the end of a range goes to sequences whose lengths are
powers of two, so nothing is padded.

Texts are tokenised once: ids are kept compressed in the shared folder, and from
there they are sampled and moved once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuskit.llm.arrays import text_slices
from corpuskit.llm.tokenizing import encoder
from corpuskit.session import shared_folder

SIZE = 4096
END_ID = 2
BUCKETS = 1024
DIMENSIONS = 3
BITS = 16
REACH = 4.0  # projections lie in about +-REACH; beyond, they fall in the last cell
SEQUENCE_BITS = 40  # numbers of sequences inside a range
RANGE_IDS = 1 << 24  # ids in a range, about: what one task lays out


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of grid coordinates (Skilling's
    transform of axes to a transposed index, for all rows at once)."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(dims):
            flip = (x[:, i] & level) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where(x[:, dims - 1] & level, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Hilbert keys of consecutive documents, given all their ids."""
    bucket = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    keys, ends = [], np.cumsum(counts)
    for a in range(0, len(counts), 512):
        own = counts[a : a + 512]
        first = ends[a] - counts[a]
        part = bucket[first : first + own.sum()] + np.repeat(np.arange(len(own)) * BUCKETS, own)
        vector = np.sqrt(np.bincount(part, minlength=len(own) * BUCKETS).reshape(-1, BUCKETS))
        vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
        cells = np.clip((vector @ projection + REACH) * ((1 << BITS) / (2 * REACH)), 0, (1 << BITS) - 1)
        keys.append(hilbert_key(cells.astype(np.int64)))
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, tie, n_tokens, ids): ids as zstandard-compressed little-endian
    32-bit numbers, the end id last."""
    kind = docs.schema[id_col].dataType.simpleString()
    projection = np.random.default_rng(5).standard_normal((BUCKETS, DIMENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = encoder(tokenizer).encode, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(2)):
                ids, counts = encode(data, offsets)
                keys = curve_keys(ids, counts, projection)
                parts = [pack.compress(np.append(own, np.uint32(end_id)).astype("<u4").tobytes()) for own in np.split(ids, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(keys), batch.column(1).slice(first, last - first), pa.array(counts + 1), pa.array(parts, pa.binary())],
                    names=["id", "key", "tie", "n_tokens", "ids"],
                )

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("tie"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, key long, tie long, n_tokens long, ids binary"
    )


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, `start` (its document's ids before it), `length`, `ids`
    (little-endian unsigned 32-bit), `doc_tokens`, `sequence_id`, `offset` (in the
    sequence, from 0 without gaps).

    A null text is empty: its document is the end id alone. Every id of every row
    lies in exactly one piece; repeated rows are packed each. Sequence numbers are
    unique, not consecutive. Other columns are dropped; no rows give no pieces.
    `size` must be a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    tokenised(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "none").parquet(folder)
    stored = spark.read.parquet(folder)
    ids = stored.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, -(-ids // RANGE_IDS))
    ordered = stored.repartitionByRange(ranges, "key", "tie").sortWithinPartitions("key", "tie", "id", "ids")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        sequence = TaskContext.get().partitionId() << SEQUENCE_BITS
        waiting: list = []  # (id, start, doc tokens, ids) of less than a sequence
        held = 0

        def laid(pieces: list, number: int) -> list:
            rows, at = [], 0
            for own, start, total, ids in pieces:
                rows.append((own, start, len(ids), ids.tobytes(), total, number, at))
                at += len(ids)
            return rows

        def out(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            kinds = [id_kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        id_kind = None
        for batch in batches:
            id_kind = batch.column(0).type
            rows, gathered = [], 0
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(unpack.decompress(packed.as_py()), "<u4")
                at = 0
                while at < len(ids):
                    part = ids[at : at + size - held]
                    waiting.append((own, at, len(ids), part))
                    at += len(part)
                    held += len(part)
                    if held == size:
                        rows += laid(waiting, sequence)
                        sequence += 1
                        waiting, held = [], 0
                        gathered += size
                if gathered > 1 << 20:
                    yield out(rows)
                    rows, gathered = [], 0
            yield out(rows)
        if held:
            yield out(_tail(waiting, held, sequence, laid))

    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ordered.select("id", "ids").mapInArrow(run, schema)


def _tail(waiting: list, held: int, sequence: int, laid) -> list:
    """Lays the rest of a range in sequences whose lengths are powers of two."""
    rows: list = []
    while held:
        room = 1 << (held.bit_length() - 1)
        held -= room
        taken = []
        while room:
            own, start, total, ids = waiting[0]
            part = ids[:room]
            taken.append((own, start, total, part))
            room -= len(part)
            waiting = waiting[1:] if len(part) == len(ids) else [(own, start + len(part), total, ids[len(part) :]), *waiting[1:]]
        rows += laid(taken, sequence)
        sequence += 1
    return rows
