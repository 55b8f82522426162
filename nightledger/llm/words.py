"""Vectorised word access over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; it never spans two texts.
Word hashes are polynomial hashes of the UTF-8 bytes modulo 2**64, passed through a 64-bit mixer,
so they are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text handled at once; a longer single text is handled whole
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column), pa.string())
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, offsets from 0) of consecutive texts of at most ``limit`` bytes, or of one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of some texts: ``start`` and ``end`` in bytes, ``first[i]:first[i+1]`` are text i's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        solid = ~_SPACE[data]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = solid
        before[offsets[:-1]] = False
        after = np.empty(n + 1, bool)
        after[-1] = False
        after[:-1] = solid
        after[offsets[1:]] = False
        self.start = np.flatnonzero(solid & ~before[:n])
        self.end = np.flatnonzero(solid & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.solid = solid

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(_INVERSE, n + 1)[self.start])


def windows(hashes: np.ndarray, first: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``width`` consecutive words of one text.

    Returns (hash, index of the window's first word, windows of each text). A text of fewer words has none.
    """
    n, counts = len(hashes), np.maximum(np.diff(first) - width + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * powers(base, n), out=sums[1:])
    ends = np.cumsum(counts)
    at = np.arange(ends[-1]) - np.repeat(ends - counts - first[:-1], counts)
    return mix((sums[at + width] - sums[at]) * powers(pow(base, -1, 1 << 64), n)[at]), at, counts


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space."""
    raw = data.tobytes()
    return b" ".join([raw[s:e] for s, e in zip(start.tolist(), end.tolist())])


def string_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string(), safe=False)
