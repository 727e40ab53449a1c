"""Words of many texts as numpy arrays, straight from an Arrow string buffer.

A word is identified by a 64-bit polynomial hash of its bytes (modulo 2**64
with an odd base, so that any span's hash follows from two prefix sums), put
through a bit mixer.  Work is done in slices of half a MB of text so that the
arrays beside the text stay small.  A single longer text is one slice, whose
words are hashed in blocks of that size all the same.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1 << 19

#: [\x20\x09-\x0D] separate words.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and digits and all bytes of non-ASCII characters make words.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x41:0x5B] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MASK = (1 << 64) - 1


def _line(base: np.uint64, n: int) -> np.ndarray:
    line = np.full(n, base, np.uint64)
    line[0] = 1
    return np.cumprod(line, dtype=np.uint64)


#: BASE**i and INVERSE**i for the places of a block.
UP, DOWN = _line(BASE, SLICE_BYTES + 1), _line(INVERSE, SLICE_BYTES + 1)


def _long_hash(data: np.ndarray) -> int:
    """The polynomial of one span that is longer than a block."""
    total, scale, step = 0, 1, pow(int(BASE), SLICE_BYTES, 1 << 64)
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES].astype(np.uint64) + np.uint64(1)
        part *= UP[: len(part)]
        total += int(part.sum(dtype=np.uint64)) * scale
        scale = scale * step & _MASK
    return total & _MASK


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomials, not yet mixed, of spans that are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))
        if to <= at:
            out[at] = _long_hash(data[base : ends[at]])
            at += 1
            continue
        block = np.zeros(int(ends[to - 1]) - base + 1, np.uint64)
        block[1:] = data[base : ends[to - 1]]
        block[1:] += np.uint64(1)
        block[1:] *= UP[: len(block) - 1]
        np.cumsum(block, out=block)
        first = starts[at:to] - base
        out[at:to] = (block[ends[at:to] - base] - block[first]) * DOWN[first]
        at = to
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release_memory() -> None:
    """Give memory that is free again back to the system, which the allocators keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into the bytes) of runs of rows of at most ``limit`` bytes; null is an empty text."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    if len(text) == 0:
        return
    wide = pa.types.is_large_string(text.type)
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(text))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Word starts, ends and hashes of the texts of one slice; ``bounds[i]:bounds[i+1]`` are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        if lower:
            data = LOWER[data]
        self.data = data
        n = len(data)
        inside = table[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:n]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        return mix(span_hashes(self.data, self.starts, self.ends))


def grams(words: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (across text bounds too; callers cut there)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    c = np.uint64(seed | 1)
    for j in range(1, k):
        out *= c
        out += words[j : j + n]
    return mix(out)
