"""Token ids as binary files of bit or byte planes.

A file holds the ids of consecutive documents in blocks of `BLOCK` ids. A block
is transposed to planes (byte k, or bit k, of each id), each plane is compressed
with zstandard, and the chunk index at the end of the file says where each plane
lies, so that any run of ids can be read alone:

    magic | planes of block 0 | planes of block 1 | ... | index | index length (8 bytes) | magic

The index is compressed JSON: block size, plane kind, the number of ids, per
block its place, its ids and the lengths of its planes, and where the document
ids and their numbers of tokens lie.

Documents are range-partitioned by id, so file n holds what stands before file
n + 1. A file is written under a name of its own by every attempt of a task, and
only files of attempts that succeeded are listed: losing an executor leaves at
most a file that nothing reads.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpuskit.llm.arrays import text_slices
from corpuskit.llm.tokenizing import encoder
from corpuskit.session import cut_lineage, shared_folder
from corpuskit.sizing import file_system

MAGIC = b"CKPLANE1"
BLOCK = 1 << 16
END_ID = 1


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [plane.tobytes() for plane in by_byte]
    bits = np.unpackbits(by_byte[:, :, None], axis=2, bitorder="little")
    return [np.packbits(bits[k, :, b], bitorder="little").tobytes() for k in range(4) for b in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        stacked = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes])
        stacked = np.packbits(bits.reshape(4, 8, n), axis=1, bitorder="little").reshape(4, n)
    return np.ascontiguousarray(stacked.T).view("<u4").ravel()


class Writer:
    """Writes one file, block by block."""

    def __init__(self, stream, kind: str, block: int):
        self.stream, self.kind, self.block = stream, kind, block
        self.squeeze = zstandard.ZstdCompressor(level=3).compress
        self.at, self.total, self.waiting, self.held, self.blocks = len(MAGIC), 0, [], 0, []
        stream.write(MAGIC)

    def _put(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        place = self.at
        lengths = [self._put(self.squeeze(p)) for p in to_planes(ids[:n], self.kind)]
        self.blocks.append([place, n, lengths])
        self.waiting, self.held = [ids[n:]], len(ids) - n

    def add(self, ids: np.ndarray) -> None:
        for a in range(0, len(ids), self.block):
            part = ids[a : a + self.block]
            self.waiting.append(part)
            self.held += len(part)
            self.total += len(part)
            while self.held >= self.block:
                self._flush(self.block)

    def close(self, doc_ids: pa.Array, counts: np.ndarray) -> None:
        if self.held:
            self._flush(self.held)
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([doc_ids, pa.array(counts, pa.int64())], names=["id", "n"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        documents = [self.at, self._put(self.squeeze(sink.getvalue()))]
        index = {"block": self.block, "planes": self.kind, "ids": self.total, "blocks": self.blocks, "documents": documents}
        n = self._put(self.squeeze(json.dumps(index).encode()))
        self.stream.write(struct.pack("<Q", n) + MAGIC)


class Reader:
    """Reads one file through its chunk index."""

    def __init__(self, stream, size: int):
        self.stream = stream
        self.open = zstandard.ZstdDecompressor().decompress
        (n,), magic = struct.unpack("<Q", self._take(size - 16, 8)), self._take(size - 8, 8)
        if magic != MAGIC:
            raise ValueError("not a file of planes")
        self.index = json.loads(self.open(self._take(size - 16 - n, n)))

    def _take(self, place: int, n: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(n)

    def documents(self) -> pa.RecordBatch:
        with pa.ipc.open_stream(self.open(self._take(*self.index["documents"]))) as source:
            return source.read_next_batch()

    def block(self, number: int) -> np.ndarray:
        place, n, lengths = self.index["blocks"][number]
        raw, planes, at = self._take(place, sum(lengths)), [], 0
        for length in lengths:
            planes.append(self.open(raw[at : at + length]))
            at += length
        return from_planes(planes, n, self.index["planes"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop; only the blocks that hold them are read."""
        size = self.index["block"]
        parts = [self.block(b) for b in range(start // size, -(-stop // size))] if stop > start else []
        return np.concatenate(parts)[start % size :][: stop - start] if parts else np.zeros(0, "<u4")


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, planes: str = "byte", block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """Writes the ids of all texts, each with the end id behind it, in ascending
    order of the id (null first; equal ids by hash of their texts). Returns the
    files: (file_no, path, n_docs, n_ids, base), `base` the ids before the file.

    A null text counts as empty. Repeated rows are written each. Only one row a
    file comes to the driver. An empty table gives no files.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/planes-{uuid.uuid4().hex}"
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = task.partitionId()
        encode = encoder(tokenizer).encode
        system, root = file_system(folder)
        path, writer, names, counts = f"part-{number:06d}-{task.taskAttemptId()}.planes", None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(root, recursive=True)
                stream = system.open_output_stream(f"{root}/{path}")
                writer = Writer(stream, planes, block)
            names.append(batch.column(0))
            for _, _, data, offsets in text_slices(batch.column(1)):
                ids, own = encode(data, offsets)
                # The end id stands behind each document's last id.
                writer.add(np.insert(ids, np.cumsum(own), np.uint32(end_id)))
                counts.append(own + 1)
        if writer is not None:
            total = np.concatenate(counts)
            writer.close(pa.chunked_array(names).combine_chunks(), total)
            stream.close()
            yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_docs": [len(total)], "n_ids": [int(total.sum())]})

    files = cut_lineage(ordered.mapInArrow(run, "file_no long, path string, n_docs long, n_ids long")).orderBy("file_no").collect()
    rows, base = [], 0
    for f in files:
        rows.append((f["file_no"], f"{folder}/{f['path']}", f["n_docs"], f["n_ids"], base))
        base += f["n_ids"]
    return spark.createDataFrame(rows, "file_no long, path string, n_docs long, n_ids long, base long")


def read(files: DataFrame, id_type: str = "long", id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of every document in the listed files: `start`
    counts the ids of all documents before it, `ids` are little-endian unsigned
    32-bit numbers. A file is read by one task, block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = file_system(path)
                with system.open_input_file(place) as stream:
                    reader = Reader(stream, stream.size())
                    documents = reader.documents()
                    counts = documents.column(1).to_numpy()
                    starts = np.cumsum(counts) - counts
                    first = 0
                    while first < len(counts):
                        last = max(int(np.searchsorted(starts + counts, starts[first] + (1 << 20), side="right")), first + 1)
                        ids = reader.ids(int(starts[first]), int(starts[last - 1] + counts[last - 1]))
                        borders = np.concatenate([starts[first:last], [starts[last - 1] + counts[last - 1]]]) - starts[first]
                        values = pa.Array.from_buffers(
                            pa.large_binary(), last - first, [None, pa.py_buffer((4 * borders).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]
                        ).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [documents.column(0).slice(first, last - first), pa.array(base + starts[first:last]), pa.array(counts[first:last]), values],
                            names=[id_col, "start", "n_tokens", "ids"],
                        )
                        first = last

    return files.select("path", "base").mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, ids binary")
