"""Vectorised word splitting and rolling hashes over Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D.  Hashes are 64-bit polynomials
(Rabin-Karp) followed by a bit mixer, so equal word sequences always hash alike.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _WORD_BASE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that are neither ASCII letters or digits nor part of a multi-byte character.
NOT_ALNUM = np.array([not (chr(b).isalnum() if b < 128 else True) for b in range(256)])
#: Bytes of text handled at once inside a task; bounds numpy's temporaries.
CHUNK = 1 << 20
#: Bytes or words that share one run of powers.
SEGMENT = 1 << 18


@functools.lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    up, down = np.full(n, base, U), np.full(n, pow(int(base), -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 16
    while size < n:
        size *= 2
    up, down = _powers(int(base), size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = CHUNK):
    """Row ranges (lo, hi) of a string column that hold about `most` bytes, one row at least."""
    _, offsets = string_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """The words of some rows: hashes, byte ranges and each row's range of words."""

    def __init__(self, column: pa.Array, lower: bool = False, breaks: np.ndarray = SPACE):
        data, offsets = string_bytes(column)
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~breaks[data]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edge], after[edge - 1] = False, False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        #: Row r has the words first[r] to first[r + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    @functools.cached_property
    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        out, lo = np.empty(len(self.starts), U), 0
        while lo < len(out):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + SEGMENT)))
            base = self.starts[lo]
            part = self.data[base : self.ends[hi - 1]].astype(U) + U(1)
            up, down = powers(_BASE, len(part))
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part * up, dtype=U, out=total[1:])
            s, e = self.starts[lo:hi] - base, self.ends[lo:hi] - base
            out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
            lo = hi
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions among all words at which k words of one row start, and their Rabin-Karp hashes."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))
        at = np.flatnonzero(left >= k)
        return at, window_hashes(self.hashes, k)[at]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of the k words from each position on; 0 where fewer are left."""
    out, step = np.zeros(len(words), U), SEGMENT
    for lo in range(0, len(words) - k + 1, step):
        part = words[lo : lo + step + k - 1]
        up, down = powers(_WORD_BASE, len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * up, dtype=U, out=total[1:])
        n = len(part) - k + 1
        out[lo : lo + n] = mix((total[k:] - total[:n]) * down[:n])
    return out
