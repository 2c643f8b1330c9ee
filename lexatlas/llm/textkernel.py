"""Vectorised byte kernels over Arrow string columns (numpy, whole batches, no per-character Python)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Odd multiplier of the polynomial rolling hash modulo 2**64, and its inverse. Such hashes only choose places (anchors);
#: what is held equal is told by span_codes or span_digests.
RADIX = 0x9E3779B97F4A7C15
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
#: Slices of about this many bytes keep the working set in the processor's cache.
SLICE_BYTES = 1 << 20

_tables: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Return what freed arrays held to the system: workers are used again, and would keep the most they ever needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def of_batches(run):
    """A mapInArrow function that gives memory back when its task ends."""

    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


def of_group(run):
    """The same of an applyInArrow function of a group."""

    def tidy(table):
        try:
            return run(table)
        finally:
            give_back()

    return tidy


def of_pair(run):
    """The same of a function of two groups."""

    def tidy(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    return tidy


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown on demand and kept."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        a[0] = 1
        have = _tables[base] = np.multiply.accumulate(a)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """pre with pre[j] - pre[i] = sum of (byte + 1) * RADIX**position over [i, j)."""
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(RADIX, len(data)), out=pre[1:])
    return pre


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, most_docs: int = 1 << 62) -> Iterator[tuple[int, int]]:
    """Runs of at most `most_docs` documents [a, b) and of about `most` bytes; a longer document is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1), a + most_docs)
        yield a, min(b, n)
        a = min(b, n)


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Spans of more bytes than this are hashed one by one.
LONG_WORD = 64


def span_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit xxh3 digests of the byte spans [start, end)."""
    raw = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), wherever they lie: eight bytes at a time, each step through a nonlinear mix.

    No sum of powers takes part, so texts that differ by a rule (one and its complement, say) do not meet.
    """
    size = end - start
    h = mix(size.astype(np.uint64) * U(0xD6E8FEB86659FD93) + U(RADIX))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at, left, rest = start, size, None
    for k in range(LONG_WORD // 8):
        got = eight[at]
        short = left < 8
        got[short] &= (U(1) << (left[short].astype(np.uint64) * U(8))) - U(1)
        if rest is None:
            h = mix(h ^ got)
        else:
            h[rest] = mix((h[rest] + U(0xA0761D6478BD642F)) ^ got)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        rest = more if rest is None else rest[more]
        at, left = at[more] + 8, left[more] - 8
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        h[long] = span_digests(data, start[long], end[long])
    return h


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a run of documents: start, end (bytes in the run), document and hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, space: np.ndarray = SPACE):
        """space: of each byte, whether it parts words."""
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        word = ~space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~word[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~word[1:]
        self.start = np.flatnonzero(word & (before | edge[:-1]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.hash = span_codes(self.data, self.start, self.end)
        #: words of document d are first[d] .. first[d + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the n words that begin at each word; valid if all lie in its document."""
        m = len(self.hash)
        if m < n:
            return np.zeros(m, np.uint64), np.zeros(m, bool)
        acc = np.zeros(m - n + 1, np.uint64)
        for k in range(n):
            acc = acc * U(0xA0761D6478BD642F) + self.hash[k : m - n + 1 + k]
        h = np.zeros(m, np.uint64)
        h[: m - n + 1] = mix(acc)
        return h, np.arange(m) + n <= self.first[1:][self.doc]
