"""Vectorised byte, word and shingle hashing over Arrow string buffers.

Texts are handled as UTF-8 bytes. A polynomial prefix hash modulo 2**64 gives the
hash of any byte range in constant time, so words, chunks and n-grams need no
Python loop per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes hashed at a time; a word is never cut
U64 = np.uint64
_M1, _M2, _G = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n reproducible pseudo-random 64-bit words."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * _G)


EXACT = stream64(256, 7)
LOWER = EXACT.copy()
LOWER[65:91] = EXACT[97:123]

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, PIECE + (1 << 16))
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, factor, dtype=U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _trim() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: None


_malloc_trim = _trim()


def give_back() -> None:
    """Returns freed memory to the machine: a Python worker is kept for later tasks, with all that it ever took."""
    pa.default_memory_pool().release_unused()
    _malloc_trim(0)


class Prefix:
    """Range hashes over one piece of bytes."""

    def __init__(self, piece: np.ndarray, table: np.ndarray):
        up, self.down = powers(len(piece) + 1)
        self.sums = np.zeros(len(piece) + 1, dtype=U64)
        np.cumsum(table[piece] * up[: len(piece)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    wide = column.cast(pa.large_string()).fill_null("")
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def groups(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes (PIECE if not given); a longer row is a run of its own."""
    limit = limit or PIECE
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words(NamedTuple):
    first: int  # rows first..last
    last: int
    start: np.ndarray  # byte positions in the buffer
    end: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray  # where each row's words begin


def _pieces(data: np.ndarray, lo: int, hi: int, breaks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts [lo, hi) where a separator (True in breaks) allows it."""
    while hi - lo > PIECE + (1 << 15):
        cut = lo + PIECE
        window = np.flatnonzero(breaks[data[lo + PIECE // 2 : cut]])
        if len(window):
            cut = lo + PIECE // 2 + int(window[-1]) + 1
        else:
            after = next((p + int(x[0]) + 1 for p in range(cut, hi, PIECE) if len(x := np.flatnonzero(breaks[data[p : min(hi, p + PIECE)]]))), hi)
            cut = after
        yield lo, cut
        lo = cut
    if lo < hi:
        yield lo, hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER, separator: np.ndarray = SPACE) -> Iterator[Words]:
    """Maximal runs of non-separator bytes, with their hashes, in groups of rows."""
    for first, last in groups(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        row_starts = offsets[first:last]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in _pieces(data, lo, hi, separator):
            piece = data[a:b]
            sep = separator[piece]
            begins = np.empty(len(piece) + 1, dtype=bool)  # a word may begin here
            begins[0] = begins[-1] = True
            begins[1:-1] = sep[:-1]
            inside = row_starts[(row_starts >= a) & (row_starts < b)] - a
            begins[inside] = True
            start = np.flatnonzero(begins[:-1] & ~sep)
            end = np.flatnonzero((begins[1:] | np.append(sep[1:], True)) & ~sep) + 1
            found.append((start + a, end + a, Prefix(piece, table).ranges(start, end)))
        start, end, hashed = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
        yield Words(first, last, start, end, hashed, np.searchsorted(start, offsets[first : last + 1]))


_STEPS = stream64(64, 11) | U64(1)


def shingle_sets(found: Words, width: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles of ``width`` words.

    A row with fewer words has one shingle, the whole sequence; one without words none.
    """
    h, n = found.hash, len(found.hash)
    rolled = np.zeros(0, U64)
    if n >= width:
        rolled = h[: n - width + 1] * _STEPS[0]
        for k in range(1, width):
            rolled = rolled + h[k : n - width + 1 + k] * _STEPS[k]
        rolled = mix64(rolled)
    for a, b in zip(found.ptr[:-1], found.ptr[1:]):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            yield mix64((h[a:b] * _STEPS[: b - a]).sum(dtype=U64, keepdims=True) + _STEPS[60 : 61] * U64(b - a))
        else:
            yield np.zeros(0, U64)
