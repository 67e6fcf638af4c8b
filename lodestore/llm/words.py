"""Words of Arrow string columns as 64-bit hashes, without a Python object per word.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. Everything works on chunks of whole texts, so
memory is bounded by the chunk size or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lodestore.llm.common import worker_state

CHUNK_BYTES = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> _33)
    x = x * _M1
    x ^= x >> _33
    x = x * _M2
    x ^= x >> _33
    return x


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as asked for; up to ``KEPT`` are kept."""

    KEPT = 1 << 22

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _first(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            made = self._first(self.base, n), self._first(self.inverse, n)
            if n > self.KEPT:
                return made
            self.up, self.down = made
        return self.up, self.down


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 64, 256, dtype=np.uint64)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of a string column without nulls."""
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and of each text the number of words before it (one more than texts)."""
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of each word, with ASCII letters lowered if so told."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = worker_state("powers", lambda: Powers(0x9E3779B97F4A7C15)).upto(len(data) + 1)
    values = worker_state("byte-values", _byte_values)
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((values[_LOW] if lower else values)[data] * up[: len(data)], out=summed[1:])
    return mix((summed[ends] - summed[starts]) * down[starts])


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words, in order, and of each text the number of them before it. A text with
    fewer words, but any, gives one: of all its words."""
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    before = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(before[-1], np.uint64)
    place = np.arange(before[-1]) - np.repeat(before[:-1], many) + np.repeat(first[:-1], many)
    whole = np.repeat(n >= width, many)
    at = place[whole]
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = mix(total + hashes[at + k] + np.uint64(k + 1))
    out[whole] = total
    for d in np.flatnonzero((n > 0) & (n < width)):
        one = np.full(1, n[d] << 32, np.uint64)
        for h in hashes[first[d] : first[d + 1]]:
            one = mix(one + h)
        out[before[d]] = one[0]
    return out, before
