"""Phrases whose words stand together more often than their parts would by themselves, for each language.

Every task counts the words, pairs and longer runs of words of its shards of text in a trie of limited depth: lang,
first word, second word and so on, each node with its number of places. A trie is kept level by level, sorted, each
node with its parent, its word and its count; it is cut at bounds of whole paths, and the piece of each range of
paths is sent there, led by the nodes on the way to its first path, whose counts the range needs but doesn't own. A
range merges the sorted levels of all shards from the top; below a node of too few places nothing can have enough, so
its branches are left out. Walking down to a phrase gives the places of its left parts. The places of its right part
are those of the phrase's suffix link, the node of the phrase without its first word: links are followed by a join on
(lang, phrase), one for each depth, and the suffix brings the links of its own.

Scores are exact decimals up to 38 digits. Null text counts as empty, null lang as `und`; repeated rows count each;
words may be of any length; an empty table gives no rows. Only text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.llm import textkernel as tk
from upland.llm import tries
from upland.llm.common import cut
from upland.operators.topk import first_in_groups

#: Words of the longest phrase; places of a candidate; rows for each lang; percent of a phrase's places that a longer one has.
DEPTH, LEAST, MOST, PERCENT = 3, 10, 2000, 50
UNIT = 10**6

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = ENDS.copy()
SEPARATORS[[0x20, 0x09]] = True


class Level:
    """Nodes of one depth, ascending by their paths: key = parent's place * words + word."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.key, self.count = key, count


class Trie:
    """Counts of all runs of words of up to `depth` words; level 0 has the langs and all their words."""

    def __init__(self, shard: pa.Table, depth: int = DEPTH):
        w, text, offsets = tries.tokens(shard.column("text"), SEPARATORS)
        self.words, place, lang = tries.interned(w, SEPARATORS, shard.column("lang").combine_chunks())
        size = max(1, len(self.words))
        ends = np.cumsum(np.concatenate([[0], ENDS[w.data]]))[w.start] + text  # grows wherever a piece ends
        key, count = np.unique(lang[text], return_counts=True)
        self.levels = [Level(key, count)]
        at = np.arange(len(place))
        node = np.searchsorted(key, lang[text])
        for k in range(depth):
            if k:
                inside = np.flatnonzero(at + k < len(place))
                inside = inside[ends[at[inside]] == ends[at[inside] + k]]
                at, node = at[inside], node[inside]
            key, node, count = np.unique(node * size + place[at + k], return_inverse=True, return_counts=True)
            self.levels.append(Level(key, count))

    def sample(self, share: float) -> list[tries.Key]:
        """Whole paths of that share of the deepest nodes."""
        key = self.levels[-1].key
        place = np.flatnonzero(np.random.default_rng(len(key)).random(len(key)) < share)
        path, size = [], max(1, len(self.words))
        for level in reversed(self.levels):
            key = level.key[place]
            place = key // size
            path.append(key % size)
        return [tuple(self.words[k] for k in reversed(x)) for x in zip(*(p.tolist() for p in path), strict=True)]

    def pieces(self, edges: list[tries.Key]) -> Iterator[tuple[int, bytes]]:
        """The number and the bytes of each range's piece.

        A piece has of each level where its own nodes begin and, before them, the node that the edge passes through
        if it is there; such a node is the earlier range's, and marked."""
        size = max(1, len(self.words))
        through, begin, own = np.ones(len(edges), bool), np.zeros(len(edges), np.int64), []
        for k, level in enumerate(self.levels):
            at, known = tries.find(self.words, [e[k] for e in edges])
            wanted = begin * size + np.where(through, at, 0)
            begin = np.searchsorted(level.key, wanted)
            there = np.append(level.key, -1)[begin] == wanted
            last = k == len(self.levels) - 1
            through = through & known & there & (not last)
            own.append((begin, through))
        for r in range(len(edges) + 1):
            arrays, used, low = [], [], []
            for level, (begin, through) in zip(self.levels, own, strict=True):
                led = bool(r and through[r - 1])
                i = int(begin[r - 1]) if r else 0
                j = int(begin[r] + through[r]) if r < len(edges) else len(level.key)
                low.append(i)
                used.append(level.key[i:j] % size)
                parent = level.key[i:j] // size - (low[-2] if len(low) > 1 else 0)
                arrays += [np.array([led]), parent, level.count[i:j]]
            if sum(len(x) for x in used):
                words, back = np.unique(np.concatenate(used), return_inverse=True)
                local = np.split(back, np.cumsum([len(x) for x in used])[:-1])
                for k, (one, array) in enumerate(zip(local, used, strict=True)):
                    parent = arrays[3 * k + 1]
                    children = np.bincount(parent, minlength=len(used[k - 1])) if k else np.zeros(0, np.int64)
                    arrays[3 * k + 1] = children
                    arrays[3 * k] = np.concatenate([arrays[3 * k].astype(np.int64), one])
                yield r, tries.packed(arrays, [self.words[k] for k in words.tolist()])


class Piece:
    def __init__(self, data: bytes):
        arrays, self.words = tries.unpacked(data)
        self.led, self.word, self.parent, self.count = [], [], [], []
        for k in range(0, len(arrays), 3):
            self.led.append(bool(arrays[k][0]))
            self.word.append(arrays[k][1:])
            self.parent.append(np.repeat(np.arange(len(arrays[k + 1]), dtype=np.int32), arrays[k + 1]) if k else np.zeros(len(arrays[k]) - 1, np.int32))
            self.count.append(arrays[k + 2])


NODE = "lang string, depth int, phrase string, suffix string, f long, n long, lefts array<long>"


def merged_nodes(parts: list[Piece], least: int) -> Iterator[pa.RecordBatch]:
    """Nodes of `least` places or more that the range owns, as rows of NODE."""
    words, rank = tries.united([p.words for p in parts])
    size = max(1, len(words))
    names = pa.array([x.decode() for x in words], pa.string())
    parent = [np.zeros(len(p.word[0]), np.int64) for p in parts]
    lang = phrase = suffix = lefts = None
    for depth in range(len(parts[0].word)):
        here = [x >= 0 for x in parent]
        runs = [x[h] * size + r[p.word[depth]][h] for x, h, r, p in zip(parent, here, rank, parts, strict=True)]
        key, count, place = tries.merged(runs, [p.count[depth][h] for h, p in zip(here, parts, strict=True)])
        own = np.ones(len(key), bool)
        for p, h, x in zip(parts, here, place, strict=True):
            if p.led[depth] and len(h) and h[0]:
                own[x[0]] = False
        kept = count >= (least if depth else 0)
        new = np.where(kept, np.cumsum(kept) - 1, -1)
        if depth + 1 < len(parts[0].word):
            parent = []
            for p, h, x in zip(parts, here, place, strict=True):
                node = np.full(len(h), -1, np.int64)
                node[h] = new[x]
                parent.append(node[p.parent[depth + 1]])
        above, word = key[kept] // size, names.take(pa.array(key[kept] % size))
        if depth == 0:
            lang, lefts = word, count[kept][:, None]
            continue
        lang = lang.take(pa.array(above))
        suffix = pa.nulls(len(word), pa.string()) if depth == 1 else word if depth == 2 else pc.binary_join_element_wise(suffix.take(pa.array(above)), word, " ")
        phrase = word if depth == 1 else pc.binary_join_element_wise(phrase.take(pa.array(above)), word, " ")
        lefts = lefts[above]
        mine = np.flatnonzero(own[kept])
        f = count[kept]
        for at in range(0, len(mine), 1 << 16):
            rows = mine[at : at + (1 << 16)]
            some = pa.array(rows)
            flat = lefts[rows][:, 1:]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), pa.int64()))
            columns = [lang.take(some), pa.array(np.full(len(rows), depth, np.int32)), phrase.take(some), suffix.take(some), pa.array(f[rows]), pa.array(lefts[rows, 0]), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in NODE.split(", ")])
        lefts = np.concatenate([lefts, f[:, None]], 1)


def nodes(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, size: int = tries.RANGE, shard: int = tries.SHARD) -> DataFrame:
    """A written row for each run of up to `depth` words with `least` places or more in its lang: the words after the
    first as `suffix`, its places f, all words of the lang n, and the places of its left parts, shortest first."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    edges = tries.bounds(rows, "text", tries.sized(rows), lambda table, share: Trie(table, depth).sample(share), size)

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tries.shards(batches, "text", shard):
            for number, data in Trie(part, depth).pieces(edges):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["range", "piece"])

    def together(table: pa.Table) -> pa.Table:
        parts = [Piece(x.as_py()) for x in table.column("piece")]
        out = pa.Table.from_batches(list(merged_nodes(parts, least)), schema)
        del parts
        tk.give_back()
        return out

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in NODE.split(", ")])
    return cut(rows.mapInArrow(run, "range int, piece binary").groupBy("range").applyInArrow(together, NODE), "phrase-nodes")


def linked(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Phrases of two words or more with the places of their right parts: without the first word, without two, and so on."""
    short = found.filter("depth = 1").withColumn("rights", F.array().cast("array<long>"))
    every = None
    for d in range(2, depth + 1):
        link = short.select("lang", F.col("phrase").alias("suffix"), F.concat(F.array("f"), "rights").alias("rights"))
        short = found.filter(F.col("depth") == d).join(link, ["lang", "suffix"])
        every = short if every is None else every.unionByName(short)
    return every


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(UNIT * a * a / (left * right)) of longs; Spark's decimals have 38 digits, so a may have 16."""
    big = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(a)).cast("decimal(32,0)") * F.lit(UNIT).cast("decimal(7,0)"), big(left) * big(right))


def scored(phrases: DataFrame) -> DataFrame:
    """l, r and score of the cut that scores least, ties to the shortest first part."""
    cuts = F.arrays_zip(F.col("lefts").alias("l"), F.col("rights").alias("r"))
    each = F.transform(cuts, lambda c, k: F.struct(exact_score(F.col("f"), c["l"], c["r"]).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    return phrases.withColumn("cut", F.array_min(each)).select("lang", "depth", "phrase", F.col("f").alias("a"), "n", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, most: int = MOST, percent: int = PERCENT, size: int = tries.RANGE, shard: int = tries.SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's first `most` candidates.

    A candidate whose words a longer one of at least `percent` of its places contains is left out."""
    every = cut(scored(linked(nodes(docs, depth, least, size, shard), depth)), "phrases")
    w = F.split("phrase", " ")
    windows = [
        F.filter(F.array(F.lit(None).cast("string"), *[F.concat_ws(" ", F.slice(w, at + 1, k)) for at in range(depth - k + 1)]), lambda x: x.isNotNull())
        for k in range(2, depth)
    ]
    longer = every.filter("depth > 2").select("lang", "a", "depth", *[x.alias(f"w{k}") for k, x in enumerate(windows, 2)])
    inner = [longer.filter(F.col("depth") > k).select("lang", "a", F.explode(F.array_distinct(F.slice(f"w{k}", 1, F.col("depth") - k + 1))).alias("phrase")) for k in range(2, depth)]
    left = every
    if inner:
        union = inner[0]
        for x in inner[1:]:
            union = union.unionByName(x)
        met = union.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        left = every.join(met, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < percent * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = first_in_groups(left.select("lang", "phrase", "a", "l", "r", "n", "score"), ["lang"], order, most, "rank")
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
