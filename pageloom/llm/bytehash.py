"""Vectorised hashing of UTF-8 text, shared by the operators that compare texts.

Everything works on the byte buffer of a whole Arrow batch (no Python string is made).
A hash of any substring comes from prefix sums of ``byte * BASE**position`` modulo 2**64,
so one pass serves every word, shingle and k-gram.  Two independent bases give 128 bits
where a hash stands for a text without a later comparison.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MASK = (1 << 64) - 1


class Powers:
    """BASE**i and BASE**-i modulo 2**64, grown on demand and kept per process."""

    _kept: dict[int, "Powers"] = {}

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    @classmethod
    def of(cls, base: int, n: int) -> "Powers":
        p = cls._kept.setdefault(base, cls(base))
        while len(p.up) < n:
            k = len(p.up)
            p.up = np.concatenate([p.up, p.up * U64(pow(base, k, 1 << 64))])
            p.down = np.concatenate([p.down, p.down * U64(pow(p.inverse, k, 1 << 64))])
        return p


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def prefix_sums(data: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """One longer than data; sums[i] covers data[:i]."""
    out = np.zeros(len(data) + 1, U64)
    up = Powers.of(base, len(data) + 1).up
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hash of data[start:end] for each pair; the length is part of it."""
    down = Powers.of(base, len(sums)).down
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))


def kgrams(sums: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every k-byte substring, unmixed (equal strings, equal values)."""
    n = len(sums) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    return (sums[k:] - sums[:-k]) * Powers.of(base, n).down[:n]


def tidy(batches: Iterator) -> Iterator:
    """The batches; between them, and at the end, freed memory goes back to the system.

    Python workers live on from task to task, and their allocator would keep what one operator's task has used.
    Within a batch it shall keep it, though: else each numpy step waits for fresh pages.
    """
    hold()
    for b in batches:
        yield b
        del b
        trim()


@lru_cache(maxsize=1)
def hold() -> None:
    """Once a process: arrays up to 32 MB come from the heap, and it shrinks only when trimmed (or by 256 MB at once)."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n+1 offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(offsets: np.ndarray, most: int = 1 << 18):
    """Ranges (i, j) of texts of up to ``most`` bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE, lower: bool = True):
    """Words of the texts data[bounds[t]:bounds[t+1]] (bounds from 0): (starts, ends, first word of each text + total, lowered data)."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate([inside[1:], [False]]) if n else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, bounds), data


_MULTIPLIERS = np.array([pow(0xA24BAED4963EE407, i + 1, 1 << 64) for i in range(16)], U64)


def shingles(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row and the text of each.

    A text of fewer words, but not none, has one shingle of them all.
    """
    n = len(word_hash)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    if n >= size:
        h = np.zeros(n - size + 1, U64)
        for i in range(size):
            h += word_hash[i : n - size + 1 + i] * _MULTIPLIERS[i]
        whole = text[: n - size + 1] == text[size - 1 :]
        out, of = mix(h[whole]), text[: n - size + 1][whole]
    else:
        out, of = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(size - 1):
            there = counts[short] > i
            extra[there] += word_hash[first[short[there]] + i] * _MULTIPLIERS[i]
        extra = mix(extra + counts[short].astype(U64) * U64(0x632BE59BD9B4E019))
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of
