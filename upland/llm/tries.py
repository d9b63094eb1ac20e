"""What the count tries of phrases and terms share: interned words, ranges of keys, packed arrays, sorted merges.

A shard is the texts of one task up to SHARD bytes (a longer text is a shard of its own). It makes a trie of its own,
cuts it at the bounds of the key ranges, and sends each range its piece; a range merges the pieces of all shards.
Bounds come from a sample of the texts' keys; they decide which task merges what, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm import textkernel as tk

#: Bytes of text in a shard, and in a range of keys on average.
SHARD, RANGE = 4 << 20, 8 << 20
#: Sampled keys for each range, and at least in all.
KEYS_A_RANGE, KEYS = 16, 8192


def shards(batches: Iterator[pa.RecordBatch], column: str, limit: int = SHARD) -> Iterator[pa.Table]:
    """The batches' rows in tables of about `limit` bytes of text."""
    held, size = [], 0
    for batch in batches:
        _, offsets = tk.buffers(batch.column(column))
        for i, j in tk.blocks(offsets, limit):
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                tk.give_back()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tokens(column: pa.ChunkedArray, separators: np.ndarray) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    """The words of all texts (null: empty) without hashes, the text of each, and the text's bytes before it."""
    data, offsets = tk.buffers(column)
    w = tk.words(data, offsets, 0, len(offsets) - 1, separators, hashed=False)
    return w, tk.text_of(w), offsets


def interned(w: tk.Words, separators: np.ndarray, more: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of `w`, which `separators` part, and of `more` in the order of their bytes, and the place
    there of each of either."""
    size = w.end - w.start
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = w.data[:-8][~separators[w.data[:-8]]]
    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(first), pa.py_buffer(data)])
    coded = pa.chunked_array([own, more.cast(pa.large_binary())]).combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = rank[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    return coded.dictionary.take(pa.array(order)).to_pylist(), places[: len(size)], places[len(size) :]


def find(words: list[bytes], wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted word stands, or would stand, among sorted words; and whether it is there."""
    there = np.empty(len(words), object)
    there[:] = words
    asked = np.empty(len(wanted), object)
    asked[:] = wanted
    at = np.searchsorted(there, asked)
    return at, np.array([i < len(words) and words[i] == x for i, x in zip(at.tolist(), wanted, strict=True)], bool)


def united(lists: list[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of several sorted lists, sorted, and the place there of each word of each."""
    every = pa.array([x for own in lists for x in own], pa.large_binary()).dictionary_encode()
    order = pc.sort_indices(every.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    places = rank[every.indices.to_numpy()] if len(every) else np.zeros(0, np.int64)
    return every.dictionary.take(pa.array(order)).to_pylist(), np.split(places, np.cumsum([len(x) for x in lists])[:-1])


def merged(runs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Merge ascending runs of keys: the distinct keys, their summed counts, and each run's places among the keys.

    NumPy's stable sort of integers finds the runs and merges them pairwise."""
    keys = np.concatenate(runs)
    order = keys.argsort(kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first) if len(keys) else np.zeros(0, np.int64)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[first], total, np.split(place, np.cumsum([len(r) for r in runs])[:-1])


def packed(arrays: list[np.ndarray], words: list[bytes]) -> bytes:
    """Arrays of integers that aren't negative, in byte planes of the narrowest type, and words, compressed."""
    out = [np.array([len(arrays)], np.uint64).tobytes()]
    for a in (*arrays, np.array([len(x) for x in words], np.int64)):
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(a) or a.max() <= np.iinfo(k).max)
        narrow = a.astype(kind)
        out += [np.array([len(a), narrow.itemsize], np.uint64).tobytes(), narrow.view(np.uint8).reshape(-1, narrow.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(1).compress(b"".join([*out, *words]))


def unpacked(data: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    """What was packed; the arrays keep their narrow types."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    arrays, at = [], 8
    for _ in range(int(np.frombuffer(raw, np.uint64, 1)[0]) + 1):
        n, width = map(int, np.frombuffer(raw, np.uint64, 2, at))
        planes = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        arrays.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 16 + n * width
    size = arrays[-1].astype(np.int64)
    ends = np.cumsum(size) + at
    return arrays[:-1], [raw[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]


Key = tuple[bytes, ...]


def bounds(rows: DataFrame, column: str, total: tuple[int, int], keys: Callable[[pa.Table, float], list[Key]], size: int = RANGE) -> list[Key]:
    """Keys that cut all keys into ranges of about `size` bytes of text each.

    `total`: rows, and bytes of text. `keys(table, share)` gives that share of the keys in a table of sampled rows.
    The driver holds KEYS_A_RANGE keys a range, KEYS at least."""
    n, held = total
    ranges = max(1, -(-held // size))
    wanted = max(KEYS, KEYS_A_RANGE * ranges)
    part = min(1.0, max(1000, wanted / 8) / max(n, 1))
    share = min(1.0, wanted * 6 / max(1, part * held))  # words are of about six bytes

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, column):
            found = sorted(set(keys(shard, share)))
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.binary()))], names=["key"])

    sample = rows.sample(part, 17) if part < 1 else rows
    found = sorted(tuple(map(bytes, r["key"])) for r in sample.mapInArrow(run, "key array<binary>").collect()) if ranges > 1 else []
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def sized(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and bytes of all texts."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size")).first()
    return int(row["n"]), int(row["size"])
