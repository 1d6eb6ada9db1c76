"""Vectorised tokenising and hashing of Arrow text columns, for use inside Spark tasks.

A text column is handled as one byte buffer with offsets, so a batch costs a few numpy passes over its bytes and no
Python object per word. UTF-8 bytes of non-ASCII characters are all >= 0x80, so the byte classes below equal the
character classes of the patterns they stand for. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, lower-case letters and everything beyond ASCII.
LETTERED = np.zeros(256, dtype=bool)
LETTERED[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64); other seeds give independent-looking values."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_STRETCH = (1 << 20) - 1


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most ``limit`` bytes together (a longer text stands alone)."""
    if batch.num_rows == 0:
        return
    off = buffers(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` text bytes, made of consecutive batches or of parts of them."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch, column, limit):
            off = buffers(part.column(column))[1]
            if held and size + off[-1] > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += int(off[-1])
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    pa.default_memory_pool().release_unused()


class Words:
    """Words of some texts: byte ranges in ``data``, the text of each, and per text the range of its words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.off = off
        inside = kind[self.data]
        n = len(inside)
        first, last = inside.copy(), inside.copy()
        if n:
            cut = off[(off > 0) & (off < n)]
            before, after = inside[:-1].copy(), inside[1:].copy()
            before[cut - 1] = False
            after[cut - 1] = False
            first[1:] &= ~before
            last[:-1] &= ~after
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)  # first word of each text; the last entry is the word count
        self.n = np.diff(self.first)
        self.text = np.repeat(np.arange(len(off) - 1), self.n)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):  # stretches of about a megabyte, at word ends
            a = int(self.start[at])
            stop = max(at + 1, int(np.searchsorted(self.end, a + _STRETCH, side="right")))
            b = int(self.end[stop - 1])
            up, down = _powers(max(20, (b - a).bit_length()))
            with np.errstate(over="ignore"):
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum(_BYTE[self.data[a:b]] * up[: b - a], out=total[1:])
                first, last = self.start[at:stop] - a, self.end[at:stop] - a
                out[at:stop] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * U64(_STEP))
            at = stop
        return out

    def bytes_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the chosen words."""
        return cut_out(self.data, self.start[which], self.end[which])


def cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges [start, end) of ``data`` behind one another, and their offsets."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    return data[np.repeat(start - off[:-1], size) + np.arange(off[-1])], off


def as_binary(data: np.ndarray, off: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A binary or string array over a byte buffer."""
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive entries; entry i stands for h[i:i+k]. Shorter input gives none."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for j in range(k):
            out *= U64(_STEP)
            out += h[j : j + m]
    return mix(out, seed)


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """For each start of k consecutive words of all texts: does the window stay inside one text?"""
    total = int(first[-1])
    ok = np.ones(max(0, total - k + 1), dtype=bool)
    for j in range(1, k):  # a window that starts j words before a text's first word crosses into it
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def per_table(function: Callable[[pa.Table], pa.Table | None], column: str, limit: int) -> Callable:
    """For mapInArrow: ``function`` over tables of about ``limit`` text bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, column, limit):
            out = function(table)
            if out is not None:
                yield from out.to_batches()

    return run
