"""Vectorised byte, word and shingle arithmetic over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. Hashes of byte ranges are
polynomial prefix hashes modulo 2**64 (the hash of any range costs O(1)) passed through a 64-bit finaliser.
"""

from __future__ import annotations

import ctypes
import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 21
#: Bases of the two prefix hashes (odd, so they have inverses modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pack(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift multiplies)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1024)
            step = np.full(size, self.base, U)
            step[0] = 1
            self.up = np.multiply.accumulate(step)
            step[1:] = U(self.inverse)
            self.down = np.multiply.accumulate(step)
        return self.up, self.down


_POWERS = [Powers(b) for b in BASES]


class Prefix:
    """Prefix hash of a byte array; span(a, b) hashes the ranges [a, b)."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        up, self.down = _POWERS[which].get(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row of each word), in order; `offsets` start at 0."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64)
    start, stop = word_spans(raw, offsets)
    hashes = Prefix(_LOWER[raw]).span(start, stop) ^ mix((stop - start).astype(U))
    return hashes, np.searchsorted(offsets, start, side="right") - 1


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    body = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = body.copy()
    first[1:] &= ~body[:-1] | edge[1:-1]
    last = body.copy()
    last[:-1] &= ~body[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, row of each shingle, words per row).

    A row of fewer than `size` words, but at least one, has its whole sequence as its one shingle.
    """
    hashes, rows = words(raw, offsets)
    n_rows = len(offsets) - 1
    count = np.bincount(rows, minlength=n_rows)
    if not len(hashes):
        return hashes, rows, count
    m = len(hashes) - size + 1
    out_h, out_r = np.zeros(0, U), np.zeros(0, np.int64)
    if m > 0:
        acc = np.zeros(m, U)
        for j in range(size):
            acc = acc * U(0xA24BAED4963EE407) + hashes[j : j + m]
        whole = rows[:m] == rows[size - 1 :]
        out_h, out_r = mix(acc[whole]), rows[:m][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(len(short), U)
        for j in range(size - 1):
            has = count[short] > j
            extra[has] = extra[has] * U(0xA24BAED4963EE407) + hashes[begin[short[has]] + j]
        extra = mix(extra ^ mix(count[short].astype(U) + U(77)))
        out_h, out_r = np.concatenate([out_h, extra]), np.concatenate([out_r, short])
        order = np.argsort(out_r, kind="stable")
        out_h, out_r = out_h[order], out_r[order]
    return out_h, out_r, count


def sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, empty sets included."""
    hashes, rows, _ = shingles(raw, offsets, size)
    begin = np.searchsorted(rows, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        yield i, np.unique(hashes[begin[i] : begin[i + 1]])


def each_chunk(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) for ranges of a string column."""
    raw, offsets = pack(column)
    for i, j in chunks(offsets, limit):
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def hold(values: np.ndarray) -> int:
    """An order-free 64-bit hash of a set of 64-bit hashes."""
    if not len(values):
        return 0
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(values ^ U(0x5851F42D4C957F2D))) ^ (U(len(values)) << U(1))
    return int(mix(np.array([total], U))[0])


def lean(run: Callable, rows: int = 1024) -> Callable:
    """An Arrow function over small batches, after which the worker gives its free memory back.

    Idle workers stay beside the executor's heap while the next stage runs.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield batch.slice(lo, rows)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(small(batches))
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return over
