"""Arrow and NumPy helpers shared by the operators: texts as flat arrays, word
spans, span hashes and sums over segments.

A batch of texts is worked on as one flat array of bytes or code points cut at
document borders. `slices` keeps the arrays of one step small; a text longer
than the limit is a step of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def worker_value(key: str, make: Callable[[], object]):
    """A value made once in a Python worker and kept for its later tasks."""
    store = sys.__dict__.setdefault("_corpuskit_worker_values", {})
    if key not in store:
        store[key] = make()
    return store[key]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under the limit; at least one row each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1, first + 1)
        yield first, last
        first = last


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) for ranges of rows."""
    data, offsets = utf8(column)
    for first, last in slices(offsets, limit):
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside`, cut at the offsets."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    before[cut[:-1]] = False
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[1:]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    return spans(~SPACE[data], offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the \\n-separated lines of every text, empty ones included: a
    text with n breaks has n + 1 lines."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    return starts, ends


def owners(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def line_owners(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each line of `lines`."""
    breaks = np.bincount(owners(np.flatnonzero(data == 10), offsets), minlength=len(offsets) - 1)
    return np.repeat(np.arange(len(offsets) - 1), breaks + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse, modulo 2^64."""

    def make(size: int):
        factors = np.full(size, MULTIPLIER, np.uint64)
        factors[0] = 1
        inverse = np.full(size, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        return np.cumprod(factors), np.cumprod(inverse)

    kept = sys.__dict__.setdefault("_corpuskit_powers", [None])
    if kept[0] is None or len(kept[0][0]) < n:
        kept[0] = make(max(n, SLICE_BYTES + 1))
    return kept[0][0][:n], kept[0][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes (or small symbols of `table`). The
    same symbols give the same hash in any batch."""
    table = BYTE_VALUES if table is None else table
    power, inverse = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(table[values] * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n neighbours (len - n + 1 of them)."""
    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + count]
    return mix(out)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive segments of the given lengths (0 allowed)."""
    ends = np.cumsum(counts)
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.result_type(values.dtype, np.int64)), np.cumsum(values, axis=0, dtype=np.result_type(values.dtype, np.int64))])
    return total[ends] - total[ends - counts]


def repeated(groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is there an equal key earlier in the group, or anywhere in the group)."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    both = mix(keys ^ mix(groups.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    same = np.zeros(len(keys), bool)
    ranked = both[order]
    same[1:] = ranked[1:] == ranked[:-1]
    later = np.zeros(len(keys), bool)
    later[order] = same
    any_ = same.copy()
    any_[:-1] |= same[1:]
    out = np.zeros(len(keys), bool)
    out[order] = any_
    return later, out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))



class SpanHasher:
    """`span_hashes` for many sets of spans of the same symbols."""

    def __init__(self, values: np.ndarray, table: np.ndarray = BYTE_VALUES):
        power, self.inverse = _powers(len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(table[values] * power[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
