"""Vectorised work on the bytes of whole texts: words, hashes, shingles.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which is what
``[^\\x20\\x09-\\x0D]+`` matches in UTF-8 text. Words, shingles and lines are
held as 64-bit hashes: two given values collide with probability 2**-64, so
a document pair with a million shingles each has a false match with
probability below 1e-7.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: glibc's way to return free memory, where there is one.
_LIBC = ctypes.CDLL(None) if sys.platform == "linux" else None
_TRIM = getattr(_LIBC, "malloc_trim", None)
if hasattr(_LIBC, "mallopt"):
    # blocks of 32 MB and more go back to the system when freed (M_MMAP_THRESHOLD, -3), and so does free memory of
    # over 128 MB at the end of the heap (M_TRIM_THRESHOLD, -1); relax() returns the rest after each batch
    _LIBC.mallopt(-3, 32 << 20)
    _LIBC.mallopt(-1, 128 << 20)
#: Bytes of text worked on at once, and texts at most; a longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 4096
#: Powers kept for the next chunk; those for a longer text are made again.
KEPT_POWERS = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, which is a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE_KEYS = stream(11, 256)
_BASE = int(stream(12, 1)[0]) | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


@dataclass
class Chunk:
    """Some whole texts: their bytes, and where each starts (one entry more)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def relax() -> None:
    """Give memory that is free back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES, chunk_texts: int = CHUNK_TEXTS) -> Iterator[Chunk]:
    """The texts of an Arrow string array in order, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1
        end = min(n, max(end, at + 1), at + chunk_texts)
        yield Chunk(at, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end
    relax()


@dataclass
class Words:
    """Words of a chunk. of[i]:of[i+1] are the words of text i."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def words(c: Chunk) -> Words:
    inside = ~_SPACE[c.data]
    n = len(inside)
    heads = c.offsets[:-1][c.offsets[:-1] < n]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = c.offsets[1:][c.offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(starts)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, c.offsets))


def lowered(c: Chunk) -> Chunk:
    """The chunk with A-Z in lower case; other bytes, so all of UTF-8, as they are."""
    return Chunk(c.first, _LOWER[c.data], c.offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start[i]:end[i]] for each i, in time linear in the data."""
    sums = np.zeros(len(data) + 1, U64)
    np.multiply(_BYTE_KEYS[data], _powers(_BASE, len(data)), out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[end] - sums[start]) * _powers(_BASE_INVERSE, len(data) + 1)[start] + (end - start).astype(U64))


def word_hashes(c: Chunk, w: Words) -> np.ndarray:
    return span_hashes(c.data, w.start, w.end)


_STEPS = stream(13, 64) | U64(1)


def windows(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-item windows that lie inside one text, and their bounds by text."""
    lengths = np.maximum(np.diff(of) - (n - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    total = len(hashes) - n + 1
    if total <= 0 or not bounds[-1]:
        return np.zeros(0, U64), bounds
    h = hashes[:total] * _STEPS[0]
    for j in range(1, n):
        h += hashes[j : j + total] * _STEPS[j]
    at = np.repeat(of[:-1] - bounds[:-1], lengths) + np.arange(bounds[-1])
    return mix(h[at]), bounds


def shingle_sets(c: Chunk, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles as sorted hashes.

    A text with some words but fewer than n has one shingle, the whole
    sequence; a text without words has none.
    """
    if lower:
        c = lowered(c)
    w = words(c)
    h = word_hashes(c, w)
    g, bounds = windows(h, w.of, n)
    for i in range(len(c)):
        if bounds[i + 1] > bounds[i]:
            yield np.unique(g[bounds[i] : bounds[i + 1]])
        elif w.of[i + 1] > w.of[i]:
            few = h[w.of[i] : w.of[i + 1]]
            yield mix(np.sum(few * _STEPS[32 : 32 + len(few)], dtype=U64)[None] + U64(len(few)))
        else:
            yield np.zeros(0, U64)
