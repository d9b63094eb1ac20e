"""Word tables of whole text columns, computed on Arrow's byte buffers with NumPy.

A text column arrives as one byte buffer with offsets. Words are found and hashed for all its texts at
once, block by block (BLOCK bytes), so memory stays bounded and no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once. A longer single text is a block of its own.
BLOCK = 1 << 20

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: White space of the contracts: the characters 0x20 and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of licence words: ASCII other than digits and lower-case letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def give_back() -> None:
    """Return freed memory to the system; a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker holds no freed memory after its task."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of a block of texts; `first[i]` to `first[i + 1]` are those of the block's text i."""

    data: np.ndarray  # the block's bytes, lower-cased if asked for, with 8 bytes of padding
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold at most `limit` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, separators: np.ndarray = SPACES, lower: bool = True, seed: int = 0, hashed: bool = True) -> Words:
    """The words of texts i to j - 1: runs of bytes that are no separators; without hashes unless `hashed`."""
    base, top = int(offsets[i]), int(offsets[j])
    text = np.zeros(top - base + 8, np.uint8)
    text[: top - base] = _LOWER[data[base:top]] if lower else data[base:top]
    at = offsets[i : j + 1] - base
    inside = ~separators[text[: top - base]]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = at[1:-1][at[1:-1] < top - base]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(text, start, end, np.searchsorted(start, at), hashes(text, start, end, seed) if hashed else np.zeros(0, np.uint64))


def hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time; no two strings of up to eight bytes and equal length collide."""
    lanes = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    size = end - start
    out = (size.astype(np.uint64) + np.uint64(seed + 1)) * _M3
    todo, done = np.arange(len(start)), 0
    while len(todo):
        rest = size[todo] - done
        lane = lanes[start[todo] + done]
        short = rest < 8
        lane[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[todo] = mix(out[todo] ^ lane)
        todo, done = todo[rest > 8], done + 8
    return out


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and the index of their first word, by text; texts of fewer words have none."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[: total - n + 1] * _M3
    for k in range(1, n):
        h = mix(h + np.uint64(k)) + w.hash[k : total - n + 1 + k]
    h = mix(h)
    last = w.first[1:][np.searchsorted(w.first, np.arange(total - n + 1), "right") - 1]
    at = np.flatnonzero(np.arange(total - n + 1) + n <= last)
    return h[at], at


def text_of(w: Words) -> np.ndarray:
    """The text of each word, as its index in the block."""
    return np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
