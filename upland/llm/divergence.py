"""How the sources of a language differ in the terms they use.

Every task counts the terms of its shards of text in a radix trie of bytes. A leaf is a (lang, term) and has one
counter for each source that uses it, and the number of documents that do. A trie is kept in the order of its walk:
each leaf as the number of path bytes that it shares with the leaf before (where the paths branch) and the rest of
its path. Tries are cut at bounds of keys and merged by range, and only terms of enough documents stay (FEW). Sums
over those leaves give every group's tokens N and every language's terms V; then each range's trie is walked once
more, in the order of UTF-8, and streams

* the summed divergence of each pair of sources over its terms, added up over ranges afterwards;
* each group's best terms of the range, ties in the order of the walk, of which the best over all ranges follow.

All arithmetic is in exact integers. Null text, lang and source count as ''. Repeated rows count each; a group
without terms has N = 0; a language without kept terms gives pairs of value 0; an empty table gives no rows. Only
text, lang and source are read.

The list of groups, one row a (lang, source), is held by the driver and each task: a language of S sources has
S * (S - 1) rows in the result, so the list is small beside it. Beyond GROUPS it is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from upland.llm import textkernel as tk
from upland.llm import tries
from upland.llm.common import cut

#: Documents of its language that a kept term is in; ranks of terms reported; groups in all.
FEW, RANKS, GROUPS = 3, 200, 1 << 20
UNIT = 10**9
#: Counters laid out densely at once, and cells of a block of pairs.
DENSE, CELLS = 1 << 20, 1 << 22

#: Separators of terms: ASCII other than letters.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


class Trie(NamedTuple):
    """Leaves in the order of their paths, four bytes of lang and then the term; leaf i has counters first[i] to first[i + 1]."""

    path: list[bytes]
    documents: np.ndarray
    first: np.ndarray
    group: np.ndarray
    count: np.ndarray


def shared_bytes(path: list[bytes]) -> np.ndarray:
    """How many bytes each path has in common with the one before."""
    size = np.array([len(x) for x in path], np.int64)
    if not len(size):
        return size
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(path) + bytes(8), np.uint8)
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    most = np.minimum(size, np.concatenate([[0], size[:-1]]))
    before = np.concatenate([[0], start[:-1]])
    out, todo, done = most.copy(), np.flatnonzero(most), 0
    while len(todo):
        differ = lanes[start[todo] + done] ^ lanes[before[todo] + done]
        low = differ & (~differ + np.uint64(1))  # its lowest set bit
        apart = differ != 0
        at = np.log2(np.maximum(low, 1).astype(float)).astype(np.int64) // 8
        out[todo[apart]] = np.minimum(most[todo[apart]], done + at[apart])
        todo, done = todo[~apart & (most[todo] > done + 8)], done + 8
    return out


def to_bytes(t: Trie) -> bytes:
    shared = shared_bytes(t.path)
    rest = [p[k:] for p, k in zip(t.path, shared.tolist(), strict=True)]
    return tries.packed([shared, t.documents, np.diff(t.first), t.group, t.count], rest)


def from_bytes(data: bytes) -> Trie:
    arrays, rest = tries.unpacked(data)
    shared, documents, sizes, group, count = (x.astype(np.int64) for x in arrays)
    path, last = [], b""
    for k, own in zip(shared.tolist(), rest, strict=True):
        last = last[:k] + own
        path.append(last)
    return Trie(path, documents, np.concatenate([[0], np.cumsum(sizes)]), group, count)


def _summed(leaf: np.ndarray, group: np.ndarray, count: np.ndarray, groups: int, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counters of (leaf, group) added up: where each leaf's begin, their groups and their counts."""
    cell, back = np.unique(leaf * groups + group, return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, back, count)
    return np.searchsorted(cell, np.arange(leaves + 1) * groups), cell % groups, total


def of_shard(shard: pa.Table, lang_of: np.ndarray, groups: int) -> tuple[Trie, list[bytes], np.ndarray]:
    """The trie of a table of text and group; the distinct words, and the key lang * words + word of each leaf."""
    w, text, offsets = tries.tokens(shard.column("text"), NOT_LETTER)
    words, place, _ = tries.interned(w, NOT_LETTER, pa.array([], pa.binary()))
    own = shard.column("group").to_numpy()
    n, v = len(offsets) - 1, max(1, len(words))
    leaf = lang_of[own][text] * v + place
    used, back = np.unique(leaf, return_inverse=True)
    pair, times = np.unique(back * max(1, n) + text, return_counts=True)  # one for each leaf and text
    at, doc = pair // max(1, n), pair % max(1, n)
    first, group, count = _summed(at, own[doc], times, groups, len(used))
    path = [int(k // v).to_bytes(4) + words[k % v] for k in used.tolist()]
    return Trie(path, np.bincount(at, minlength=len(used)), first, group, count), words, used


def piece(t: Trie, i: int, j: int) -> Trie:
    a, b = int(t.first[i]), int(t.first[j])
    return Trie(t.path[i:j], t.documents[i:j], t.first[i : j + 1] - a, t.group[a:b], t.count[a:b])


def merge(parts: list[Trie], groups: int, least: int = FEW) -> Trie:
    """One trie of all leaves that occur in `least` documents or more."""
    path, place = tries.united([p.path for p in parts])
    documents = np.zeros(len(path), np.int64)
    for p, at in zip(parts, place, strict=True):
        documents[at] += p.documents  # a part has a leaf once
    leaf = np.concatenate([np.repeat(at, np.diff(p.first)) for p, at in zip(parts, place, strict=True)])
    kept = documents >= least
    here = kept[leaf]
    at = np.cumsum(kept) - 1
    group, count = np.concatenate([p.group for p in parts]), np.concatenate([p.count for p in parts])
    first, group, count = _summed(at[leaf[here]], group[here], count[here], groups, int(kept.sum()))
    return Trie([x for x, k in zip(path, kept.tolist(), strict=True) if k], documents[kept], first, group, count)


class Groups(NamedTuple):
    """All (lang, source), ascending by their bytes."""

    lang: list[str]
    source: list[str]
    lang_of: np.ndarray  # the place of each group's lang among all langs

    def span(self, lang: int) -> tuple[int, int]:
        a, b = np.searchsorted(self.lang_of, [lang, lang + 1])
        return int(a), int(b)


def all_groups(rows: DataFrame) -> tuple[Groups, tuple[int, int]]:
    """The groups, and the rows and bytes of text in all."""
    size = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")]
    found = rows.groupBy("lang", "source").agg(*size).limit(GROUPS + 1).collect()
    if len(found) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups of lang and source")
    found.sort(key=lambda r: (r["lang"].encode(), r["source"].encode()))
    lang = [r["lang"] for r in found]
    new = np.array([k > 0 and lang[k] != lang[k - 1] for k in range(len(lang))], bool)
    return Groups(lang, [r["source"] for r in found], np.cumsum(new)), (sum(r["n"] for r in found), sum(r["size"] for r in found))


def _numbered(table: pa.Table, number: dict[tuple[str, str], int]) -> pa.Table:
    """text and the group's number of a table of text, lang and source."""
    lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    lang, source = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (lang, source))
    pair, back = np.unique(lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(), return_inverse=True)
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    ids = np.array([number[langs[k // len(sources)], sources[k % len(sources)]] for k in pair.tolist()], np.int64)
    return pa.table({"text": table.column("text"), "group": ids[back] if len(ids) else np.zeros(0, np.int64)})


def merged_tries(rows: DataFrame, groups: Groups, total: tuple[int, int], least: int = FEW, size: int = tries.RANGE, shard: int = tries.SHARD) -> DataFrame:
    """A written row for each range of keys: range and its merged trie, of terms of `least` documents of their lang."""
    number, g = {x: k for k, x in enumerate(zip(groups.lang, groups.source, strict=True))}, max(1, len(groups.lang))

    def keys(table: pa.Table, share: float) -> list[tries.Key]:
        path = of_shard(_numbered(table, number), groups.lang_of, g)[0].path
        return [(path[k],) for k in np.flatnonzero(np.random.default_rng(len(path)).random(len(path)) < share)]

    edges = [k[0] for k in tries.bounds(rows, "text", total, keys, size)]

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tries.shards(batches, "text", shard):
            t, words, used = of_shard(_numbered(part, number), groups.lang_of, g)
            at, _ = tries.find(words, [x[4:] for x in edges])
            langs = np.array([int.from_bytes(x[:4]) for x in edges], np.int64)
            ends = [0, *np.searchsorted(used, langs * max(1, len(words)) + at).tolist(), len(used)]
            full = [k for k in range(len(ends) - 1) if ends[k] < ends[k + 1]]
            blobs = [to_bytes(piece(t, ends[k], ends[k + 1])) for k in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["range", "trie"])

    def together(key: tuple, table: pa.Table) -> pa.Table:
        whole = merge([from_bytes(x.as_py()) for x in table.column("trie")], g, least)
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "trie": pa.array([to_bytes(whole)], pa.binary())})

    pieces = rows.mapInArrow(run, "range int, trie binary")
    return cut(pieces.groupBy("range").applyInArrow(together, "range int, trie binary"), "term-tries")


class Totals(NamedTuple):
    tokens: np.ndarray  # N of each group
    terms: np.ndarray  # V of each lang
    of_lang: np.ndarray  # N of each lang


def totals(merged: DataFrame, groups: Groups) -> Totals:
    """Sums over all kept leaves; a row for each lang and group comes to the driver."""

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("trie"):
                t = from_bytes(x.as_py())
                group, back = np.unique(t.group, return_inverse=True)
                n = np.zeros(len(group), np.int64)
                np.add.at(n, back, t.count)
                lang, v = np.unique([int.from_bytes(p[:4]) for p in t.path], return_counts=True)
                kind = pa.array(["group"] * len(group) + ["lang"] * len(lang), pa.string())
                yield pa.RecordBatch.from_arrays([kind, pa.array([*group.tolist(), *map(int, lang)], pa.int64()), pa.array([*n.tolist(), *v.tolist()], pa.int64())], names=["kind", "id", "n"])

    langs = int(groups.lang_of[-1]) + 1 if len(groups.lang) else 0
    out = {"group": np.zeros(len(groups.lang), np.int64), "lang": np.zeros(langs, np.int64)}
    for r in merged.mapInArrow(run, "kind string, id long, n long").groupBy("kind", "id").agg(F.sum("n").alias("n")).collect():
        out[r["kind"]][r["id"]] = r["n"]
    of_lang = np.zeros(langs, np.int64)
    np.add.at(of_lang, groups.lang_of, out["group"])
    return Totals(out["group"], out["lang"], of_lang)


def share(count: np.ndarray, tokens: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / (tokens + terms)), in steps of a thousand, so that nothing passes 64 bits."""
    below = tokens + terms
    whole, rest = np.divmod(count + 1, below)
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // below, rest % below
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) * (p - q) / q); both lie between 1 and UNIT + 1."""
    return (p - q) ** 2 // q


def blocks(t: Trie, sent: tuple[Groups, Totals], dense: int = DENSE) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """The leaves of one lang after another in blocks: lang, first and last leaf, and counts by leaf and source."""
    groups, _ = sent
    lang = np.array([int.from_bytes(p[:4]) for p in t.path], np.int64)
    for own in np.unique(lang).tolist():
        a, b = groups.span(own)
        low, high = np.searchsorted(lang, [own, own + 1]).tolist()
        step = max(1, dense // (b - a))
        for i in range(low, high, step):
            j = min(i + step, high)
            counts = np.zeros((j - i, b - a), np.int64)
            cells = slice(int(t.first[i]), int(t.first[j]))
            counts[np.repeat(np.arange(j - i), np.diff(t.first[i : j + 1])), t.group[cells] - a] = t.count[cells]
            yield own, i, j, counts


def pair_sums(t: Trie, sent: tuple[Groups, Totals], dense: int = DENSE, most: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Group, other group of its lang, and the divergence summed over the trie's leaves, for one band of groups after another."""
    groups, n = sent
    for own in np.unique([int.from_bytes(p[:4]) for p in t.path]).tolist():
        a, b = groups.span(own)
        band = max(1, min(b - a, dense // (b - a)))
        for low in range(a, b, band):
            high, total = min(low + band, b), None
            for lang, _, _, counts in blocks(t, sent, dense):
                if lang == own:
                    p = share(counts, n.tokens[a:b], int(n.terms[own]))
                    step = max(1, most // ((high - low) * (b - a)))
                    for i in range(0, len(p), step):
                        part = divergence(p[i : i + step, low - a : high - a, None], p[i : i + step, None, :]).sum(0)
                        total = part if total is None else total + part
            yield np.repeat(np.arange(low, high), b - a), np.tile(np.arange(a, b), high - low), total.ravel()


def best_terms(t: Trie, sent: tuple[Groups, Totals], ranks: int = RANKS, dense: int = DENSE) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Each group's first `ranks` terms by divergence from the lang, and their values; ties stay in the order of the walk."""
    groups, n = sent
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for own, i, _, counts in blocks(t, sent, dense):
        a, b = groups.span(own)
        p = share(counts, n.tokens[a:b], int(n.terms[own]))
        q = share(counts.sum(1), n.of_lang[own], int(n.terms[own]))[:, None]
        for k in range(b - a):
            leaf = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q[:, 0]))
            value = divergence(p[leaf, k], q[leaf, 0])
            if len(leaf):
                leaf, value = leaf + i, value
                if a + k in held:
                    leaf, value = np.concatenate([held[a + k][0], leaf]), np.concatenate([held[a + k][1], value])
                first = np.argsort(-value, kind="stable")[:ranks]
                first.sort()
                held[a + k] = leaf[first], value[first]
    for group, (leaf, value) in held.items():
        yield group, [t.path[k][4:].decode() for k in leaf.tolist()], value


def _walk(sent: Broadcast, ranks: int):
    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("trie"):
                t = from_bytes(x.as_py())
                for p, q, value in pair_sums(t, sent.value):
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.nulls(len(p), pa.string()), pa.array(value)], names=["p", "q", "term", "value"])
                for group, terms, value in best_terms(t, sent.value, ranks):
                    k = len(terms)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, group)), pa.nulls(k, pa.int64()), pa.array(terms, pa.string()), pa.array(value)], names=["p", "q", "term", "value"])

    return run


def audit(docs: DataFrame, least: int = FEW, ranks: int = RANKS, size: int = tries.RANGE, shard: int = tries.SHARD) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank: see the module's head.

    A `pair` row's item is another source of the lang, a `term` row's a term that the source uses more than the lang."""
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("text"), text("lang"), text("source"))
    groups, total = all_groups(rows)
    merged = merged_tries(rows, groups, total, least, size, shard)
    sent = spark.sparkContext.broadcast((groups, totals(merged, groups)))
    found = cut(merged.mapInArrow(_walk(sent, ranks), "p long, q long, term string, value long"), "term-walks")

    listed = pd.DataFrame({"id": np.arange(len(groups.lang)), "lang": groups.lang, "source": groups.source})
    known = spark.createDataFrame(listed, "id long, lang string, source string")
    other = known.select(F.col("id").alias("q"), "lang", F.col("source").alias("item"))
    sums = found.filter("term is null and p != q").groupBy("p", "q").agg(F.sum("value").alias("value"))
    each = known.select(F.col("id").alias("p"), "lang", "source").join(other, "lang").filter("p != q")  # the pairs that are asked for
    pairs = each.join(sums, ["p", "q"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    terms = found.filter("term is not null").select(F.col("p").alias("id"), F.col("term").alias("item"), "value").join(known, "id")
    place: Column = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", place).filter(F.col("rank") <= ranks)
    return pairs.withColumn("rank", place).unionByName(first)
