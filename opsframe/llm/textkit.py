"""Vectorised word handling inside Arrow tasks.

Texts stay in their Arrow byte buffers: words, hashes and shingles of a whole
chunk are computed by a handful of numpy passes instead of a Python loop over
words.  Chunks are bounded in bytes, so that a task's memory does not depend on
the batch size or on how long single texts are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text forms a chunk of its own.
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_LANES = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        p, q = np.full(size, _BASE), np.full(size, inverse)
        p[0] = q[0] = 1
        _powers, _inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers, _inverses


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(raw: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes (or a single row)."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(end, start + 1))
        yield start, end
        start = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, as byte ranges and hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        solid = ~_SPACE[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        starts = offsets[:-1][offsets[:-1] < n]
        first[starts] = solid[starts]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = solid[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words before each text: text i has words bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.start, offsets)
        self.lower = lower
        self._hash: np.ndarray | None = None
        self._running: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def running(self) -> np.ndarray:
        """Running polynomial hash of the bytes; ranges of bytes are hashed by differences of it."""
        if self._running is None:
            power, _ = _power_tables(len(self.raw) + 1)
            value = _BYTE[_LOWER[self.raw]] if self.lower else _BYTE[self.raw]
            self._running = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum(value * power[: len(self.raw)], out=self._running[1:])
        return self._running

    def prefix(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of at least ``length`` bytes, and hashes of their first ``length`` bytes."""
        have = np.flatnonzero(self.end - self.start >= length)
        at = self.start[have]
        return have, mix((self.running[at + length] - self.running[at]) * _power_tables(0)[1][at] + _LANES[length])

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word, A-Z lower-cased if asked for."""
        if self._hash is None:
            h = (self.running[self.end] - self.running[self.start]) * _power_tables(0)[1][self.start]
            self._hash = mix(h + (self.end - self.start).astype(np.uint64) * _LANES[15])
        return self._hash


def roll(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (len - width + 1 of them)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n] * _LANES[0]
    for k in range(1, width):
        total = total + h[k : k + n] * _LANES[k]
    return mix(total)


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text; with fewer words, the whole sequence as one."""
    h, b = words.hash, words.bounds
    rolled = roll(h, width)
    for i in range(len(b) - 1):
        lo, hi = b[i], b[i + 1]
        if hi - lo >= width:
            s = np.sort(rolled[lo : hi - width + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif hi > lo:
            yield mix((h[lo:hi] * _LANES[: hi - lo]).sum(keepdims=True) + np.array([hi - lo], np.uint64) * _LANES[14])
        else:
            yield np.zeros(0, np.uint64)


def running_windows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for Karp-Rabin hashes of windows of any length, and the factors that shift windows to the origin."""
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(h), _BASE))))
    inverse = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(h), np.uint64(pow(int(_BASE), -1, 1 << 64))))))
    return np.concatenate(([np.uint64(0)], np.cumsum(h * power[:-1]))), inverse


def released() -> None:
    """At the end of a task: give freed memory back to the system, as the worker idles while the executor goes on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
