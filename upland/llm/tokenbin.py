"""Token ids in a binary file format of shuffled planes.

Texts become token ids; the ids of all texts, in ascending doc_id order and each closed by an end id, form
one stream. The stream is cut into shards (one per range of doc_id) and those into blocks of `block_ids`
ids. A block's 32-bit ids are transposed into byte planes (or bit planes), each compressed with zstandard.

A block is one row of a Parquet folder, whose commit protocol keeps whole shards when executors are lost:

    shard, block     place of the block
    start, n_ids     ids of the shard before it, and in it
    payload          MAGIC, mode (0 bytes, 1 bits), planes, n_ids, length of each plane, then the planes
    index            the texts with ids in the block: doc_id, ordinal in the shard, ids of the text before
                     the block, ids in the block, ids of the text in all

All but `payload` is the chunk index: column pruning reads it without touching the planes.
Ids are those of the tokenizer's own call on the whole text without special tokens added; a special token's
string within a text gives that token's id, as the call does.

Null texts count as empty and give the end id alone; null doc_ids come first; rows of equal doc_id follow each
other in the order of a hash of their texts, and are dealt to shards like others; an empty table gives an
empty folder.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from upland.llm import textkernel as tk
from upland.llm.common import new_folder

MAGIC = b"UPT1"
BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = (
    "shard int, block int, start long, n_ids int, payload binary, "
    "index array<struct<doc_id:long,ordinal:long,at:long,n:int,total:long>>"
)

#: Words whose ids a worker remembers; beyond it the cache starts anew.
CACHE_WORDS = 700_000
#: New words are kept apart, and join the others once there are so many.
FRESH_WORDS = 50_000
#: Bytes of text that are cut and encoded at once; working arrays take about 60 times as much.
BLOCK_BYTES = 1 << 19

#: Kinds of bytes. Before a mark that follows a letter or digit the split pattern always splits.
OTHER, SPACE, LETTER, DIGIT, MARK = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[tk.SPACES] = SPACE
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK

#: White space outside ASCII, as the tokenizer's split pattern has it (fixed values).
WIDE_SPACES = "\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The first two bytes of each of these in UTF-8.
WIDE_PAIRS = np.array([0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380], np.uint16)


def pack(ids: np.ndarray, bits: bool = False, level: int = 3) -> bytes:
    """A block's payload. Planes above the largest id's highest byte or bit are left out, being zero."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits:
        planes = [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(top)]
    else:
        by_byte = ids.view(np.uint8).reshape(-1, 4)
        planes = [by_byte[:, k].tobytes() for k in range((top + 7) // 8)]
    squeeze = zstandard.ZstdCompressor(level=level)
    planes = [squeeze.compress(p) for p in planes]
    head = MAGIC + struct.pack("<BBI", bits, len(planes), len(ids)) + struct.pack(f"<{len(planes)}I", *map(len, planes))
    return head + b"".join(planes)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    bits, count, n = struct.unpack_from("<BBI", payload, 4)
    sizes = struct.unpack_from(f"<{count}I", payload, 10)
    at, out = 10 + 4 * count, np.zeros(n, "<u4")
    by_byte, expand = out.view(np.uint8).reshape(-1, 4), zstandard.ZstdDecompressor()
    for k, size in enumerate(sizes):
        plane = np.frombuffer(expand.decompress(payload[at : at + size], max_output_size=max(n, 1)), np.uint8)
        if bits:
            out |= np.unpackbits(plane, count=n).astype("<u4") << np.uint32(k)
        else:
            by_byte[:, k] = plane
        at += size
    return out


def _applied(matrix: list[int], vector: int) -> int:
    total, k = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[k]
        vector, k = vector >> 1, k + 1
    return total


@functools.cache
def _zeros(k: int) -> list[int]:
    """What 2 ** k zero bits do to a CRC-32, as a bit matrix."""
    if k == 0:
        return [0xEDB88320, *[1 << j for j in range(31)]]
    half = _zeros(k - 1)
    return [_applied(half, x) for x in half]


def crc_join(a: int, b: int, n: int) -> int:
    """The CRC-32 of two strings together, from that of each and the second's length."""
    k = 3  # bits of a byte
    while n:
        if n & 1:
            a = _applied(_zeros(k), a)
        n, k = n >> 1, k + 1
    return a ^ b


class Cache:
    """Ids of pieces by hash: two ascending tables, one of them small and often rewritten."""

    def __init__(self) -> None:
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.tables = [self._empty(), self._empty()]

    @staticmethod
    def _empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.at) - 1

    def find(self, hashes: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each piece, -1 if it isn't known, and whether its hash is another piece's."""
        place, clash = np.full(len(hashes), -1), np.zeros(len(hashes), bool)
        for known, second, where in self.tables:
            if len(known):
                spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                there = known[spot] == hashes
                place[there] = where[spot[there]]
                clash[there] = second[spot[there]] != check[there]
        return place, clash

    def add(self, hashes: np.ndarray, check: np.ndarray, found: list[list[int]]) -> np.ndarray:
        """Store ids of new pieces, whose hashes ascend; their places."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        place = len(self) + np.arange(len(hashes))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))])
        fresh = self._merged(self.tables[1], (hashes, check, place))
        if len(fresh[0]) > FRESH_WORDS:
            self.tables[0], fresh = self._merged(self.tables[0], fresh), self._empty()
        self.tables[1] = fresh
        return place

    @staticmethod
    def _merged(table: tuple, more: tuple) -> tuple:
        where = np.searchsorted(table[0], more[0])
        return tuple(np.insert(x, where, y) for x, y in zip(table, more, strict=True))


class Encoder:
    """Ids of whole columns of text. A text is cut where the tokenizer's own pattern always splits, and a worker
    runs the tokenizer once for each distinct piece it meets: the bare BPE model for an optional space and Latin
    letters, all of the tokenizer for any other piece. Texts with white space outside ASCII, or with the string of
    a special token, are encoded whole.

    Pieces are told apart by a 64-bit hash, checked against a second one when a block meets the cache."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.wide = re.compile(f"[{WIDE_SPACES}]")
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # byte-level BPE's alphabet
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = np.arange(256, dtype="<u2")
        self.alphabet[hidden] = 256 + np.arange(len(hidden))
        self.cache = Cache()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learnt(self, text: np.ndarray, first: np.ndarray, last: np.ndarray, plain: np.ndarray) -> list[list[int]]:
        """The ids of pieces not met before."""
        found: list[list[int]] = [[]] * len(first)
        shown, tokenize = self.alphabet[text].tobytes().decode("utf-16-le"), self.model.tokenize
        for k, a, b in zip(np.flatnonzero(plain).tolist(), first[plain].tolist(), last[plain].tolist(), strict=True):
            found[k] = [t.id for t in tokenize(shown[a:b])]
        if not plain.all():
            other = np.flatnonzero(~plain).tolist()
            pieces = [text[first[k] : last[k]].tobytes().decode("utf-8", "replace") for k in other]
            for k, e in zip(other, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
                found[k] = e.ids
        return found

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without the end id."""
        data, offsets = tk.buffers(column)
        for i, j in tk.blocks(offsets, BLOCK_BYTES):
            yield from self._block(data, offsets, i, j)

    def _block(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> Iterator[np.ndarray]:
        at = offsets[i : j + 1] - offsets[i]
        size = int(at[-1])
        text = np.zeros(size + 8, np.uint8)
        text[:size] = data[offsets[i] : offsets[j]]
        kind = KIND[text[:size]]
        accent = np.flatnonzero(text[:size] == 0xC3)  # Latin-1's letters are two bytes, the first of them C3
        accent = accent[~np.isin(text[accent + 1], (0x97, 0xB7)) & (text[accent + 1] >= 0x80)]
        kind[accent] = kind[accent + 1] = LETTER
        space = kind == SPACE
        head = np.zeros(size + 1, bool)
        head[at] = True
        leads = head.copy()
        opens = np.flatnonzero(~space[1:] & space[:-1]) + 1
        opens = opens[~leads[opens]]  # words with white space before them: its last character joins them if it is 0x20
        head[opens - (text[opens - 1] == 0x20)] = True
        head[opens[text[opens - 1] != 0x20]] = True
        head[opens - 1] = True
        head[1:size] |= space[1:] & ~space[:-1]
        head[1:size] |= (kind[1:] == MARK) & ((kind[:-1] == LETTER) | (kind[:-1] == DIGIT))
        head[size] = True
        cuts = np.flatnonzero(head)
        first, last = cuts[:-1], cuts[1:]
        if not len(first):
            yield from (np.zeros(0, np.uint32) for _ in range(i, j))
            return
        distinct, one, back = np.unique(tk.hashes(text, first, last), return_index=True, return_inverse=True)
        check = tk.hashes(text, first[one], last[one], seed=77)
        if len(self.cache) > CACHE_WORDS:
            self.cache = Cache()
        place, clash = self.cache.find(distinct, check)  # a clash is a piece with the hash of another
        new = place < 0
        if new.any():
            odd = np.concatenate([[0], np.cumsum(kind != LETTER)])
            a, b = first[one[new]], last[one[new]]
            plain = odd[b] - odd[a + (text[a] == 0x20)] == 0
            plain &= b - a > (text[a] == 0x20)
            place[new] = self.cache.add(distinct[new], check[new], self._learnt(text[:size], a, b, plain))
        place, starts = place[back], self.cache.at
        n = starts[place + 1] - starts[place]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.cache.ids[np.repeat(starts[place] - total[:-1], n) + np.arange(total[-1])]
        bounds = np.searchsorted(first, at)
        whole = np.zeros(j - i, bool)
        if clash.any():
            whole[np.searchsorted(at, first[clash[back]], "right") - 1] = True
        pair = text[:size].astype(np.uint16) << 8 | text[1 : size + 1]
        seen = np.flatnonzero(np.isin(pair, WIDE_PAIRS)) if (kind == OTHER).any() else ()
        for k in np.unique(np.searchsorted(at, seen, "right") - 1) if len(seen) else ():
            whole[k] |= bool(self.wide.search(text[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")))
        if self.special:
            for m in self.special.finditer(text[:size].tobytes()):
                whole[np.searchsorted(at, m.start(), "right") - 1] = True
        for k in range(j - i):
            if whole[k]:
                yield self.whole(text[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace"))
            else:
                yield ids[total[bounds[k]] : total[bounds[k + 1]]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_ENTRY = pa.struct([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("total", pa.int64())])
_BLOCK = [("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary())]


def _write_shard(
    batches: Iterable[pa.RecordBatch], shard: int, path: str, end_id: int, block_ids: int, bits: bool
) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_BLOCK, ("index", pa.list_(_ENTRY))])
    held: list[np.ndarray] = []
    index: list[dict] = []
    n = block = start = ordinal = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, index, n, block, start
        payload = pack(np.concatenate(held), bits)
        row = {"shard": shard, "block": block, "start": start, "n_ids": n, "payload": payload, "index": index}
        held, index, start, block, n = [], [], start + n, block + 1, 0
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(batch.column("text")), strict=True):
            ids, at = np.append(ids, np.uint32(end_id)), 0
            while at < len(ids):
                part = ids[at : at + block_ids - n]
                held.append(part)
                index.append({"doc_id": doc_id, "ordinal": ordinal, "at": at, "n": len(part), "total": len(ids)})
                at, n = at + len(part), n + len(part)
                if n == block_ids:
                    yield flush()
            ordinal += 1
    if n:
        yield flush()


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS, bits: bool = False) -> None:
    """Encode `text` of every row and write the blocks, in ascending doc_id order, to `folder`.

    One range shuffle of the texts; each shard is encoded as a stream, holding one block at a time. The range key
    goes on after doc_id, so that many rows of one doc_id are no single task's."""
    from pyspark import TaskContext

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_shard(batches, TaskContext.get().partitionId(), vocabulary, end_id, block_ids, bits)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = rows.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "mark", "row").sortWithinPartitions("doc_id", "mark", "text")
    ordered.select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA).write.parquet(folder)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(folder)


@tk.lean
def _read_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, at = unpack(row["payload"]), 0
            if len(ids) != row["n_ids"] or sum(x["n"] for x in row["index"]) != row["n_ids"]:
                raise ValueError(f"block {row['block']} of shard {row['shard']} does not hold what its index says")
            raw, out = ids.tobytes(), []
            for x in row["index"]:
                crc = zlib.crc32(raw[4 * at : 4 * (at + x["n"])])
                out.append((row["shard"], x["ordinal"], x["doc_id"], row["start"] + at - x["at"], x["at"], x["n"], x["total"], crc))
                at += x["n"]
            types = (pa.int32(), *[pa.int64()] * 7)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "ordinal", "doc_id", "start", "at", "n", "total", "crc"])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and ids_crc32 of every text.

    Blocks are decoded independently. A text across blocks has its pieces' checksums joined; only those few
    are shuffled. The shards' bases come from one row per shard."""
    read = blocks(spark, folder)
    sums = read.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select("shard", F.coalesce(before, F.lit(0)).alias("base"))  # a row per written partition
    schema = "shard int, ordinal long, doc_id long, start long, at long, n long, total long, crc long"
    pieces = read.mapInArrow(_read_pieces, schema)

    @F.arrow_udf("long")
    def joined(parts: pa.Array) -> pa.Array:
        out = []
        for row in parts.to_pylist():
            crc = 0
            for p in sorted(row, key=lambda p: p["at"]):
                crc = crc_join(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        return pa.array(out, pa.int64())

    whole = pieces.filter("n = total").select("shard", "doc_id", "start", "total", "crc")
    split = (
        pieces.filter("n < total")
        .groupBy("shard", "ordinal")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.first("total").alias("total"),
            F.collect_list(F.struct("at", "n", "crc")).alias("parts"),
        )
    )
    rows = whole.unionByName(split.select("shard", "doc_id", "start", "total", joined("parts").alias("crc")))
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id",
        (F.col("base") + F.col("start")).alias("start"),
        F.col("total").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )


def ids_of(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ordinal, at and ids of every piece, for readers that want the ids themselves."""
    longs = [(k, pa.int64()) for k in ("ordinal", "doc_id", "at")]
    schema = pa.schema([("shard", pa.int32()), *longs, ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, out = unpack(row["payload"]), 0, []
                for x in row["index"]:
                    own = ids[at : at + x["n"]].tolist()
                    out.append({"shard": row["shard"], **{k: x[k] for k in ("ordinal", "doc_id", "at")}, "ids": own})
                    at += x["n"]
                yield pa.RecordBatch.from_pylist(out, schema)

    return blocks(spark, folder).mapInArrow(run, "shard int, ordinal long, doc_id long, at long, ids array<long>")


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file; the package is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """Write all texts' ids to a new folder below spark.checkpoint.dir and read them back."""
    folder = new_folder(docs.sparkSession, "token-ids")
    write(docs, folder, vocabulary or vocabulary_file(), **options)
    return documents(docs.sparkSession, folder)
