"""Vectorised text primitives over Arrow string batches.

Texts are handled as one byte buffer with offsets.  Words are hashed eight bytes at a time, each block
through a bijection of 64 bits that is not linear, and their length with them; what must be exact compares
the bytes too (``same``).  Grams, all of one small length, come from prefix sums of a polynomial.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; keeps the 8-byte-per-byte arrays small.
SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LENGTH = np.uint64(0xA0761D6478BD642F)
#: Masks for the first k bytes of a block.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Texts:
    """Consecutive texts: ``buf`` holds their UTF-8 bytes, ``off`` their n + 1 offsets."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def prefix(self) -> np.ndarray:
        powers, _ = _pow(len(self.buf) + 1)
        values = _TABLE[self.buf]
        values *= powers[: len(self.buf)]
        out = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(values, out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the n + 1 word offsets of the texts."""
        inside = _IS_WORD[self.buf]
        full = self.off[:-1] < self.off[1:]
        first, last = self.off[:-1][full], self.off[1:][full] - 1
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[first] = inside[first]
        ends[:-1] &= ~inside[1:]
        ends[last] = inside[last]
        begins = np.flatnonzero(begins)
        return begins, np.flatnonzero(ends) + 1, np.searchsorted(begins, self.off)

    def word_hashes(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash for each word, and the word offsets of the texts."""
        begins, ends, at = self.words()
        return self.span_hashes(begins, ends, lower), at

    def span_hashes(self, begins: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        buf = _LOWER[self.buf] if lower else self.buf
        words, sizes = blocks(buf), ends - begins
        out = mix(sizes.astype(np.uint64) * _LENGTH)
        rows = np.flatnonzero(sizes <= _LONG) if len(sizes) and sizes.max() > _LONG else slice(None)
        begin, size, h, done = begins[rows], sizes[rows], out[rows], 0
        while len(begin):
            h = mix(h ^ (words[begin + done] & _FIRST[np.minimum(size - done, 8)]))
            out[rows] = h
            done += 8
            more = np.flatnonzero(size > done)
            rows = more if isinstance(rows, slice) else rows[more]
            begin, size, h = begin[more], size[more], h[more]
        for k in np.flatnonzero(sizes > _LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(buf[begins[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        return out

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes at each position of the buffer, texts' borders ignored."""
        n = len(self.buf) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = self.prefix()
        _, inverse = _pow(len(self.buf) + 1)
        out = sums[k:] - sums[:n]
        out *= inverse[:n]
        return mix(out)


def blocks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position of the buffer, zeros behind its end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))


def same(x: np.ndarray, x_begins: np.ndarray, y: np.ndarray, y_begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sizes[k] bytes from x_begins[k] equal those from y_begins[k]; x and y are the ``blocks`` of buffers."""
    out, rows, done = np.ones(len(sizes), bool), np.arange(len(sizes)), 0
    while len(rows):
        keep = _FIRST[np.minimum(sizes[rows] - done, 8)]
        out[rows] = (x[x_begins[rows] + done] & keep) == (y[y_begins[rows] + done] & keep)
        done += 8
        rows = rows[out[rows] & (sizes[rows] > done)]
    return out


class Growing:
    """An array that grows at its end, with some zero bytes behind."""

    def __init__(self, dtype):
        self.room, self.size = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end + 8 > len(self.room):
            room = np.zeros(2 * end + 8, self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = values
        self.size = end

    def blocks(self) -> np.ndarray:
        return np.ndarray(self.size + 1, "<u8", self.room, strides=(1,))


def strings(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The texts of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(buf, off - off[0])


def bordered(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, Texts]:
    """(index of each word's distinct word, word offsets of the texts, sizes, the distinct words, A-Z lowered, between borders)."""
    lowered = _LOWER[texts.buf]
    begins, ends, at = texts.words()
    _, where, which = np.unique(texts.span_hashes(begins, ends, lower=True), return_index=True, return_inverse=True)
    begins, sizes = begins[where], ends[where] - begins[where]
    off = np.concatenate(([0], np.cumsum(sizes + 2)))
    buf = np.zeros(int(off[-1]), np.uint8)
    buf[off[:-1]] = 2
    buf[off[1:] - 1] = 3
    if len(sizes):
        buf[gather(off[:-1] + 1, sizes)] = lowered[gather(begins, sizes)]
    return which, at, sizes, Texts(buf, off)


def slices(texts: Texts, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first, last + 1, texts) of runs of about ``limit`` bytes; a longer text is one run."""
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(texts.off, texts.off[a] + limit, "right")) - 1)
        yield a, b, Texts(texts.buf[texts.off[a] : texts.off[b]], texts.off[a : b + 1] - texts.off[a])
        a = b


def gather(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges that start at ``begins`` and have ``lengths``, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(begins, np.int64) - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total, dtype=np.int64)


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def compress(data: bytes) -> bytes:
    return pa.Codec("zstd", 3).compress(data, asbytes=True)


def decompress(data: bytes, size: int) -> memoryview | pa.Buffer:
    return pa.Codec("zstd", 3).decompress(data, size)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same function of batches, which gives back a worker's freed memory when it ends.

    A Python worker runs the tasks of many stages; without this it keeps the largest one's heap.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped
