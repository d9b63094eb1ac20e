"""Kernels of the permutation test: many shuffles of one table by hashes, in packed form.

A shuffle deals values by places in the order of md5(id-draw-seed). What tasks send each other are arrays of a draw's
hashes and values, never a row for a point and a draw: first to ranges of a draw's hashes, where they are ordered, then
to blocks of places, then to the parts of the plane whose points, or their neighbours, have those places."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Points hashed at once, so that all arrays of a step stay in a processor's cache; bytes of a batch that is sent, about.
HASHED, SENT = 1 << 13, 4 << 20
_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in turns * 4]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

HASHES = "draw int, range int, before long, high binary, low binary, xs binary"
PIECES = "block long, draw int, first long, xs binary"
PARTS = "part long, places binary, own binary, n binary, others binary"
ASKS = "block long, part long, at binary"
DEALT = "part long, block long, xs binary"
SUMS = "draw int, xl double, xx double"


def _md5_block(words: list[np.ndarray | int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digests of n messages of one block, as numbers in the order of the digests."""
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    for i in range(64):
        if i < 16:
            f = d ^ (b & (c ^ d))
        elif i < 32:
            f = c ^ (d & (b ^ c))
        elif i < 48:
            f = b ^ c ^ d
        else:
            f = c ^ (b | ~d)
        word = words[_WORD[i]]
        f += a
        if isinstance(word, int):
            f += np.uint32((_K[i] + word) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_K[i])
        turned = f << np.uint32(_TURN[i])
        f >>= np.uint32(32 - _TURN[i])
        turned |= f
        turned += b
        a, b, c, d = d, turned, b, c
    four = [(x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in zip((a, b, c, d), _START, strict=True)]
    return four[0] << np.uint64(32) | four[1], four[2] << np.uint64(32) | four[3]


def md5_halves(texts: pa.Array) -> Callable[[bytes], tuple[np.ndarray, np.ndarray]]:
    """A function of an ending that gives both halves of the MD5 digest of each text with it."""
    raw = [t.encode() for t in texts.to_pylist()]
    size = np.array([len(t) for t in raw], np.int64)
    groups = []
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        for i in range(0, len(rows), HASHED):
            own = rows[i : i + HASHED]
            groups.append((length, own, np.frombuffer(b"".join(raw[r] for r in own.tolist()), np.uint8).reshape(len(own), length)))

    def halves(ending: bytes) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.empty(len(raw), np.uint64), np.empty(len(raw), np.uint64)
        for length, own, texts in groups:
            end = length + len(ending)
            if end > 55:  # more than a block
                found = np.frombuffer(b"".join(hashlib.md5(raw[r] + ending).digest() for r in own.tolist()), ">u8").reshape(-1, 2)
                high[own], low[own] = found[:, 0], found[:, 1]
                continue
            used = end // 4 + 1
            message = np.zeros((len(own), 4 * used), np.uint8)
            message[:, :length], message[:, length:end], message[:, end] = texts, np.frombuffer(ending, np.uint8), 0x80
            words = [*np.ascontiguousarray(message.view("<u4").T), *[0] * (16 - used)]
            words[14] = 8 * end
            high[own], low[own] = _md5_block(words, len(own))
        return high, low

    return halves


def hashed(draws: range, seed: int, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The HASHES of a task's points (text, x) in each draw: a row a range, with the number of its points in the ranges before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(got) if (got := list(batches)) else None  # dealt evenly
        if table is None or not table.num_rows:
            return
        halves, x = md5_halves(table.column("text").combine_chunks()), table.column("x").to_numpy()
        rows: list[tuple] = []
        step = max(1, SENT // (24 * len(x)))
        for k, draw in enumerate(draws, 1):
            high, low = halves(b"-%d-%d" % (draw, seed))
            at = (high >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(at, kind="stable") if ranges > 1 else slice(None)
            ends = np.searchsorted(at[order], np.arange(ranges + 1))
            high, low, own = high[order], low[order], x[order]
            rows += [(draw, r, int(i), high[i:j].tobytes(), low[i:j].tobytes(), own[i:j].tobytes()) for r, (i, j) in enumerate(zip(ends, ends[1:], strict=False))]
            if k % step == 0 or k == len(draws):
                yield _batch(rows, HASHES)
                rows = []

    return run


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [(name, _TYPES[kind]) for name, kind in (f.split() for f in schema.split(", "))]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _numbers(cells: pa.ChunkedArray, kind: type) -> np.ndarray:
    found = [np.frombuffer(c.as_buffer(), kind) for c in cells if c.as_buffer().size]
    return np.concatenate(found) if found else np.zeros(0, kind)


def ordered(width: int) -> Callable[[pa.Table], pa.Table]:
    """One range of one draw's HASHES in order, as PIECES of blocks of `width` places."""

    def run(table: pa.Table) -> pa.Table:
        high, x = _numbers(table["high"], np.uint64), _numbers(table["xs"], np.float64)
        order = np.argsort(high)
        if (np.diff(sorted_high := high[order]) == 0).any() if len(high) > 1 else False:
            order = np.lexsort((_numbers(table["low"], np.uint64), high))
        del sorted_high
        x, draw, first = x[order], table["draw"][0].as_py(), sum(table["before"].to_pylist())
        blocks = range(first // width, (first + len(x) - 1) // width + 1) if len(x) else ()
        cuts = [(b, max(b * width, first), min((b + 1) * width, first + len(x))) for b in blocks]
        return pa.Table.from_batches([_batch([(b, draw, i - b * width, x[i - first : j - first].tobytes()) for b, i, j in cuts], PIECES)])

    return run


def packed(edges: pa.Table) -> pa.Table:
    """PARTS of the edges (part, place, other) of one part: all places it needs, and by their numbers among those each
    point's own and its neighbours'."""
    at, to = (edges[c].to_numpy() for c in ("place", "other"))
    order = np.argsort(at, kind="stable")
    places = np.unique(np.concatenate([at, to]))
    own, n = np.unique(at, return_counts=True)
    number = lambda p: np.searchsorted(places, p).astype(np.int32).tobytes()
    return pa.Table.from_batches([_batch([(edges["part"][0].as_py(), places.tobytes(), number(own), n.astype(np.int32).tobytes(), number(to[order]))], PARTS)])


def asks(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ASKS of parts: what each needs of each block of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cell in zip(batch.column("part").to_pylist(), batch.column("places"), strict=True):
                places = np.frombuffer(cell.as_buffer(), np.int64)
                blocks, first = np.unique(places // width, return_index=True)
                ends = [*first[1:].tolist(), len(places)]
                yield _batch([(b, part, (places[i:j] - b * width).astype(np.int32).tobytes()) for b, i, j in zip(blocks.tolist(), first.tolist(), ends, strict=True)], ASKS)

    return run


def dealt(draws: range, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """DEALT: the values of all draws of one block's places to the parts that ask for them, a point after the other."""

    def run(pieces: pa.Table, asked: pa.Table) -> pa.Table:
        x = np.full((len(draws), width), np.nan)
        for draw, first, cell in zip(pieces["draw"].to_pylist(), pieces["first"].to_pylist(), pieces["xs"], strict=True):
            own = np.frombuffer(cell.as_buffer(), np.float64)
            x[draw - draws.start, first : first + len(own)] = own
        x = np.ascontiguousarray(x.T)
        rows = zip(asked["part"].to_pylist(), asked["block"].to_pylist(), asked["at"], strict=True)
        return pa.Table.from_batches([_batch([(part, block, x[np.frombuffer(at.as_buffer(), np.int32)].tobytes())], DEALT) for part, block, at in rows] or [_batch([], DEALT)])

    return run


def products(draws: range) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """SUMS of one part: a draw's sums over the part's points of x times its neighbours' mean and of x squared."""

    def run(values: pa.Table, part: pa.Table) -> pa.Table:
        x = _numbers(values.sort_by("block")["xs"], np.float64).reshape(-1, len(draws))
        own, n, others = (_numbers(part[c], np.int32) for c in ("own", "n", "others"))
        first, xl, xx = np.cumsum(n) - n, np.zeros(len(draws)), np.zeros(len(draws))
        step = max(1, (1 << 18) // len(draws))
        for count in np.unique(n).tolist():
            for rows in np.split(found := np.flatnonzero(n == count), range(step, len(found), step)):
                lag = sum(x[others[first[rows] + j]] for j in range(count)) / count
                mine = x[own[rows]]
                xl += np.einsum("ij,ij->j", mine, lag)
                xx += np.einsum("ij,ij->j", mine, mine)
        return pa.table({"draw": np.arange(draws.start, draws.stop, dtype=np.int32), "xl": xl, "xx": xx})

    return run
