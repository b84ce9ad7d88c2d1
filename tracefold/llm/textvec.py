"""Vectorised tokenising and hashing of Arrow string batches with numpy.

A token is a maximal run of ASCII letters, digits and non-ASCII characters, lower-cased. Nulls count as
empty texts. Texts are cut into chunks of whole rows of about ``CHUNK`` bytes, so that the temporary
arrays stay small whatever the batch holds; a longer text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_BASE) + _U((salt * 0xD1B54A32D192ED03) & _MASK))


_BYTE = seeds(256, 7)
_WORD = np.array([chr(i).isascii() and chr(i).isalnum() or i >= 128 for i in range(256)], bool)
_POW: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2^64, and their inverses."""
    global _POW
    if len(_POW[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(n, _U)
            p[0], done, step = 1, 1, base
            while done < n:
                m = min(done, n - done)
                p[done : done + m] = p[:m] * _U(step)
                done, step = done + m, step * step & _MASK
            out.append(p)
        if n > 4 * CHUNK:
            return out[0], out[1]
        _POW = (out[0], out[1])
    return _POW


@dataclass
class Tokens:
    """The tokens of rows ``lo`` to ``hi``: row ``lo + i`` has those from ``first[i]`` to ``first[i + 1]``."""

    lo: int
    hi: int
    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bytes: np.ndarray
    row_at: np.ndarray
    sums: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def stems(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each token."""
        q = _powers(len(self.bytes) + 1)[1]
        return mix((self.sums[np.minimum(self.start + size, self.end)] - self.sums[self.start]) * q[self.start])

    def text(self, a: int, b: int) -> str:
        return " ".join(self.bytes[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[a:b], self.end[a:b]))


def as_strings(col) -> pa.Array:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return pc.fill_null(arr.cast(pa.large_string()), "")


def chunks(arr: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes."""
    n = len(arr)
    ends = np.cumsum(np.maximum(1, pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + size, "right")))
        yield lo, hi
        lo = hi


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array, a line feed after each row, and where the rows begin."""
    joined = pc.binary_join_element_wise(arr, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    off = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    b = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, off - off[0]


def tokens(col, size: int = CHUNK) -> Iterator[Tokens]:
    whole = as_strings(col)
    for lo, hi in chunks(whole, size):
        b, off = raw(pc.utf8_lower(whole.slice(lo, hi - lo)))
        yield tokenised(b, off, lo, hi)


def tokenised(b: np.ndarray, off: np.ndarray, lo: int, hi: int) -> Tokens:
    w = _WORD[b].view(np.int8)
    edge = np.diff(w, prepend=np.int8(0))
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    p, q = _powers(len(b) + 1)
    c = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * p[: len(b)], out=c[1:])
    h = mix((c[end] - c[start]) * q[start])
    return Tokens(lo, hi, h, np.searchsorted(start, off).astype(np.int64), start, end, b, off, c)


def grams(t: Tokens, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` tokens within a row (``skip`` tokens left out after the first), and each one's first token."""
    span = n + skip
    m = len(t.hash) - span + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = t.hash[:m].copy()
    for k in range(1, n):
        h = h * _U(_BASE) + t.hash[k + skip : k + skip + m]
    row = t.row
    at = np.flatnonzero(row[:m] == row[span - 1 : span - 1 + m])
    return mix(h[at] + _U(n * 16 + skip)), at


def fold(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash of each row of a matrix of uint64."""
    h = np.full(len(values), (salt * _BASE + 1) & _MASK, _U)
    for k in range(values.shape[1]):
        h = mix(h * _U(_BASE) + values[:, k])
    return h


def segment_min(x: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """The least of each segment; ``empty`` where there is none."""
    out = np.full(len(first) - 1, empty, x.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.minimum.reduceat(x, first[some])
    return out


def segment_sum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros((len(first) - 1, *x.shape[1:]), x.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = np.add.reduceat(x, first[some], axis=0)
    return out
