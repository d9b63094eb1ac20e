"""Jaccard join of word n-gram sets by prefix trees.

Texts with equal sets are one node. For a similarity of at least num / den, two linked sets share a token
among the first n - ceil(n * num / den) + 1 of each, in any fixed order of all tokens. The order used here puts
a band of the hash range first, and in it rare tokens before frequent ones, so a node's prefix is mostly tokens
that no other node has, and those cost nothing further. Document frequencies are exact, over all nodes.

Nodes that share a prefix token, and are near enough in size to be linked, form a group; groups that share
nodes form a cluster, found as a connected component. In a cluster the sets, in one global order, are stored in
a trie whose edges are runs of tokens; each set is probed before it is stored. A probe carries the overlap
along shared paths and leaves a subtree once the tokens left on both sides cannot reach the overlap needed, or
once all of the subtree is in the probe's own component. So each set is sent to one task, once, and copies are
not expanded into pairs.

A cluster of more than CLUSTER_TOKENS tokens or CLUSTER_NODES nodes is no task's. Chains of chance sharing make
such clusters, so its nodes are grouped anew by all of their tokens, in the order of the counts among these nodes
alone; nodes that can have no partner among them go, and the others fall into smaller clusters. Those that are
still too large, as of thousands of near copies, are worked in rounds:

1. each node at its rarest shared token, in blocks of bounded size;
2. at each token whose nodes are in several components, one node for each component;
3. at tokens still in several components, all nodes, blocks against blocks.

A token all of whose nodes are connected can add nothing and is left out, as is one with the very nodes of
another token. No link between components is lost.

Texts are lower-cased (A-Z) and cut into words at white space. Fewer than `n` words make one n-gram of the whole
sequence; no words, null text included, make an empty set, linked with nothing. Rows with equal text are
linked, also under one doc_id. A null doc_id is never a component's id unless all of its ids are null. Only
doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm import textkernel as tk
from upland.llm.common import cut, keyed_join
from upland.operators.components import components

#: Tokens of the sets that one task of a group holds at most (8 bytes each), beside a single longer set.
BLOCK_TOKENS = 4_000_000
#: Tokens and nodes of a cluster that one task works.
CLUSTER_TOKENS, CLUSTER_NODES = 400_000, 1000
#: Nodes of a cluster that one trie holds; those of a larger one are taken token by token.
TOGETHER = 500
#: The band's share of the hash range, at least, and as a multiple of the share of a set that its prefix has.
BAND, BAND_TIMES = 0.3, 1.5
#: Rounds in which nodes that can have no partner are left out and the others' shared tokens counted anew.
PEELS = 2

_SETS = "doc_id long, n long, f1 long, f2 long, in_band long, prefix long, tokens array<long>"


def token_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, ascending."""
    data, offsets = tk.buffers(column)
    for i, j in tk.blocks(offsets):
        w = tk.words(data, offsets, i, j)
        grams, at = tk.shingles(w, size)
        bounds = np.searchsorted(at, w.first)
        for k in range(j - i):
            if bounds[k] < bounds[k + 1]:
                yield np.unique(grams[bounds[k] : bounds[k + 1]])
            else:
                few = w.hash[w.first[k] : w.first[k + 1]]
                h = np.full(min(len(few), 1), len(few), np.uint64)
                for x in few:
                    h = tk.mix(h + x)
                yield h


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1 if n else 0


def prints(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums that tell sets apart."""
    with np.errstate(over="ignore"):
        return tuple(int(tk.mix(tokens ^ np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64)) for seed in (0x5BD1E995, 0xC2B2AE3D27D4EB4F))


def _prefixes(size: int, num: int, den: int):
    limit = np.uint64(min(1.0, max(BAND, BAND_TIMES * (den - num) / den)) * (2.0**64 - 2**12))

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tokens in token_sets(batch.column("text"), size):
                f, inside, p = prints(tokens), int(np.searchsorted(tokens, limit)), prefix_length(len(tokens), num, den)
                rows.append((len(tokens), *f, inside, p, tokens[: max(inside, p)].view(np.int64)))
            if rows:
                columns = list(zip(*rows, strict=True))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in columns[5]])]).astype(np.int32)), pa.array(np.concatenate(columns[5])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:5]], lists], names=["doc_id", "n", "f1", "f2", "in_band", "prefix", "tokens"])

    return run


def _full_sets(size: int):
    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(t), *prints(t), t.tobytes()) for t in token_sets(batch.column("text"), size)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["n", "f1", "f2", "tokens"])

    return run


class Trie:
    """Sets of ascending tokens; an edge holds a run of them."""

    __slots__ = ("run", "below", "least", "most", "ends", "one")

    def __init__(self, run: np.ndarray) -> None:
        self.run, self.below, self.ends = run, {}, -1
        self.least, self.most, self.one = 1 << 60, 0, -1

    def add(self, tokens: np.ndarray, name: int, group: Linker) -> None:
        node, at, n = self, 0, len(tokens)
        node._count(n, name, group)
        while at < n:
            child = node.below.get(tokens[at])
            if child is None:
                child = node.below[tokens[at]] = Trie(tokens[at:])
                at = n
            else:
                m = min(len(child.run), n - at)
                differ = np.flatnonzero(child.run[:m] != tokens[at : at + m])
                m = int(differ[0]) if len(differ) else m
                if m < len(child.run):  # the edge splits
                    top = Trie(child.run[:m])
                    top.least, top.most, top.one = child.least, child.most, child.one
                    child.run = child.run[m:]
                    top.below[child.run[0]] = child
                    child = node.below[tokens[at]] = top
                at += m
            node = child
            node._count(n, name, group)
        node.ends = name

    def _count(self, n: int, name: int, group: Linker) -> None:
        self.one = name if not self.most else self.one if self.one >= 0 and group.root(self.one) == group.root(name) else -1
        self.least, self.most = min(self.least, n), max(self.most, n)


class Linker:
    """Links the sets of a group, given the component that each has already."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.up, self.sets, self.trie = num, den, {}, {}, Trie(np.zeros(0, np.uint64))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x

    def enough(self, overlap: int, n: int, m: int) -> bool:
        return (self.num + self.den) * overlap >= self.num * (n + m)

    def probe(self, tokens: np.ndarray, name: int) -> None:
        """Link the set with all stored sets that are near enough, but for those it is connected with."""
        n, own = len(tokens), self.root(name)
        todo = [(self.trie, 0, 0)]
        while todo:
            node, depth, overlap = todo.pop()
            if node.one >= 0 and self.root(node.one) == own:
                continue
            if len(node.run):
                place = np.searchsorted(tokens, node.run)
                overlap += int((tokens[np.minimum(place, n - 1)] == node.run).sum())
                depth += len(node.run)
                left = n - int(np.searchsorted(tokens, node.run[-1], "right"))
                best = min(node.most, max(node.least, depth + left))
                if not self.enough(overlap + min(best - depth, left), n, best):
                    continue
            if node.ends >= 0 and self.enough(overlap, n, depth) and self.root(node.ends) != own:
                self.join(name, node.ends)
                own = self.root(name)
            after = list(node.below.values())
            if len(after) > 1:
                place = np.minimum(np.searchsorted(tokens, np.array([c.run[0] for c in after])), n - 1)
                after = [c for _, c in sorted(zip((bool(tokens[p] == c.run[0]) for p, c in zip(place, after, strict=True)), after, strict=True), key=lambda x: x[0])]
            todo += [(c, depth, overlap) for c in after]
            if not after or node.one < 0:
                roots = {self.root(c.one) if c.one >= 0 else -1 for c in after} | ({self.root(node.ends)} if node.ends >= 0 else set())
                if len(roots) == 1:
                    node.one = roots.pop()

    def run(self, names: list[int], before: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Edges that connect what is linked; `before` has the component of each node so far."""
        for name, component in zip(names, before, strict=True):
            self.up.setdefault(component, component)
            self.up.setdefault(name, name)
            self.join(name, component)
        started = {name: self.root(name) for name in names}
        for k in sorted(range(len(names)), key=lambda k: (len(sets[k]), names[k])):
            self.probe(sets[k], names[k])
            self.trie.add(sets[k], names[k], self)
        return sorted({(self.root(x), root) for x, root in started.items() if self.root(x) != root})


def peeled(sets: list[np.ndarray], num: int, den: int) -> tuple[list[int], list[list[int]]]:
    """The sets that may have a partner among `sets`, and groups of them that share a prefix token.

    In the order of their counts here, tokens of one set alone come first; a set with a prefix full of them has no
    partner and goes, which leaves others' tokens alone in turn."""
    token, back = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets)), size)
    prefix = np.array([prefix_length(n, num, den) for n in size.tolist()])
    alive = np.ones(len(sets), bool)
    while True:
        count = np.bincount(back[alive[owner]], minlength=len(token))
        alone = np.bincount(owner, count[back] <= 1, len(sets))
        kept = alive & (alone < prefix)
        if kept.sum() == alive.sum():
            break
        alive = kept
    groups: dict[int, list[int]] = {}
    for k in np.flatnonzero(alive).tolist():
        own = back[at[k] : at[k + 1]]
        for t in own[np.lexsort((own, count[own]))[: prefix[k]]].tolist():
            if count[t] > 1:
                groups.setdefault(t, []).append(k)
    distinct = {tuple(g): g for g in groups.values() if len(g) > 1}
    return np.flatnonzero(alive).tolist(), sorted(distinct.values(), key=lambda g: (len(g), g))


def _link_cluster(num: int, den: int, together: int):
    """node and component of the linked nodes of a cluster."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "node"])
        names, sets = rows["node"].tolist(), [np.frombuffer(t, "<u8") for t in rows["tokens"]]
        linker = Linker(num, den)
        linker.up = {x: x for x in names}
        alive, groups = peeled(sets, num, den)
        if len(alive) <= together:
            groups = [alive]
        for group in groups:
            if len({linker.root(names[k]) for k in group}) > 1:
                linker.trie = Trie(np.zeros(0, np.uint64))
                for k in group:
                    linker.probe(sets[k], names[k])
                    linker.trie.add(sets[k], names[k], linker)
        found = [(x, linker.root(x)) for x in names]
        many = {root for x, root in found if x != root}
        return pd.DataFrame([f for f in found if f[1] in many], columns=["node", "component"]).astype("int64")

    return run


def _link(num: int, den: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        edges = []
        if rows["component"].nunique() > 1:
            sets = [np.frombuffer(t, "<u8") for t in rows["tokens"]]
            edges = Linker(num, den).run(rows["node"].tolist(), rows["component"].tolist(), sets)
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


class Join:
    """The rounds over postings (token, node) of nodes with full sets."""

    def __init__(self, postings: DataFrame, sets: DataFrame, num: int, den: int) -> None:
        self.postings, self.sets, self.link = postings, sets, _link(num, den)
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("component", F.col("node"))
        return keyed_join(rows, self.labels, ["node"], "left").withColumn("component", F.coalesce("component", "node"))

    def open_tokens(self) -> DataFrame:
        """Postings at tokens whose nodes are in several components, with the component."""
        rows = self.labelled(self.postings)
        several = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("token")
        return cut(rows.join(several, "token", "left_semi"), "open-postings")

    def round(self, rows: DataFrame, across: bool = False) -> None:
        """Link the rows' nodes at each token in blocks; `across`: blocks also against each other."""
        most = BLOCK_TOKENS if across else min(BLOCK_TOKENS, CLUSTER_TOKENS)
        sizes = rows.groupBy("token").agg(F.ceil(F.sum("n") / most).alias("blocks"))
        placed = rows.join(sizes, "token").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
        if across:
            placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            placed = placed.withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})
        else:
            placed = placed.withColumn("j", F.col("i"))
        found = placed.join(self.sets.select("node", "tokens"), "node").select("token", "i", "j", "node", "component", "tokens")
        new = cut(found.groupBy("token", "i", "j").applyInPandas(self.link, "a long, b long").filter("a <> b").distinct(), "links")
        if new.isEmpty():
            return
        self.edges = new if self.edges is None else self.edges.unionByName(new)
        star = self.edges if self.labels is None else new.unionByName(self.labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.labels = cut(components(star), "components")

    def run(self) -> DataFrame | None:
        """node and component of every linked node; None if there is none."""
        rarest = self.postings.groupBy("node").agg(F.min(F.struct("df", "token", "n")).alias("x")).select("node", "x.token", "x.n")
        self.round(self.labelled(rarest))
        rows = self.open_tokens()
        heads = rows.groupBy("token", "component").agg(F.min(F.struct("node", "n")).alias("x")).select("token", "component", "x.node", "x.n")
        self.round(heads)
        rows = self.open_tokens()
        self.round(rows, across=True)
        return self.labels


def sets_of(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """A written row for each document: the set's size and fingerprint, and the tokens of its band or prefix."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(_prefixes(size, num, den), _SETS).withColumn("row", F.monotonically_increasing_id()), "token-sets")


def postings_of(sets: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """token, node, df, n: where each node's prefix has tokens that other nodes' prefixes may have; `token` is a
    token and a size class."""
    others = sets.select("row", "f1", "f2", "n").join(nodes.filter("copies > 1").select("f1", "f2", "n", "node"), ["f1", "f2", "n"]).filter("row <> node").select("row")
    ones = keyed_join(sets.filter("n > 0"), others, ["row"], "left_anti")
    at = ones.select(F.col("row").alias("node"), F.posexplode("tokens").alias("k", "token"), "in_band", "prefix", "n")
    at = at.select("node", "token", (F.col("k") < F.col("in_band")).alias("banded"))
    shared = at.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    meta = ones.select(F.col("row").alias("node"), "in_band", "prefix", "n")
    met = cut(at.join(shared, "token"), "shared-tokens")
    for _ in range(PEELS):
        filled = met.groupBy("node").agg(F.count_if("banded").alias("shared"))
        alive = keyed_join(meta, filled, ["node"], "inner").filter(F.col("in_band") - F.col("shared") < F.col("prefix")).select("node")
        left = keyed_join(met.drop("df"), cut(alive, "alive"), ["node"], "left_semi")
        again = left.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        met = cut(left.join(again, "token"), "shared-tokens")
    lists = met.groupBy("node").agg(F.collect_list(F.when(F.col("banded"), F.struct("df", "token"))).alias("inside"), F.collect_list(F.when(~F.col("banded"), F.struct("df", "token"))).alias("outside"))
    room = F.greatest(F.lit(0), F.col("prefix") - (F.col("in_band") - F.size("inside"))).cast("int")
    kept = lists.join(meta, "node").select("node", "n", F.concat(F.slice(F.sort_array("inside"), F.lit(1), room), F.col("outside")).alias("tokens"))
    return grouped(cut(kept.select("node", "n", F.inline("tokens")), "postings"), num, den)


def grouped(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Postings (node, n, df, token) by token and size class, without groups that can add no link; as written."""
    # linked sizes differ by no more than num / den, so they meet in one of two neighbouring size classes
    size_class = F.floor(F.log("n") / math.log(den / num)) if den > num else F.col("n")
    classes = F.array(size_class, size_class + 1) if den > num else F.array(size_class)
    rows = rows.withColumn("class", F.explode(classes)).select("node", "n", "df", F.xxhash64("token", "class").alias("token"))
    # tokens left with one node link nothing; tokens with the same nodes are one
    group = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.lit(7), "node").cast("decimal(38,0)")).alias("s2"), F.min("df").alias("df"))
    one = group.filter("m > 1").groupBy("m", "s1", "s2").agg(F.min(F.struct("df", "token")).alias("x")).select(F.col("x.token").alias("token"))
    return cut(rows.join(one, "token", "left_semi"), "postings")


@tk.lean
def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and token of every token of full sets."""
    for batch in batches:
        raw, offsets = tk.buffers(batch.column("tokens"))
        for i, j in tk.blocks(offsets):
            tokens = raw[offsets[i] : offsets[j]].view("<i8")
            node = np.repeat(batch.column("node").to_numpy()[i:j], np.diff(offsets[i : j + 1]) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(tokens)], names=["node", "token"])


def regrouped(full: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Postings of the nodes by all of their tokens, rare ones among these nodes first."""
    sets = keyed_join(full, nodes, ["node"], "inner")
    dealt = sets.select("node", "tokens").repartition("node")  # the join may have left the sets of a large cluster in few tasks
    at = cut(dealt.mapInArrow(_tokens_of, "node long, token long"), "tokens-of-large")
    prefix = (F.col("n") - F.floor((F.col("n") * num + (den - 1)) / den) + 1).alias("prefix")
    meta = cut(sets.select("node", "n", prefix), "large-nodes")

    def shared(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        return rows.join(counts, "token")

    left = at
    for _ in range(PEELS):
        filled = shared(left).groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
        alive = meta.join(filled, "node").filter(F.col("n") - F.col("shared") < F.col("prefix")).select("node")
        left = keyed_join(at, cut(alive, "alive"), ["node"], "left_semi")
    lists = shared(left).groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("found"))
    room = F.greatest(F.lit(0), F.col("prefix") - (F.col("n") - F.size("found"))).cast("int")
    kept = lists.join(meta, "node").select("node", "n", F.slice(F.sort_array("found"), F.lit(1), room).alias("found"))
    return grouped(cut(kept.select("node", "n", F.inline("found")), "large-postings"), num, den)


def clusters_of(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cluster, node and n of the nodes of small clusters, and node of those of large ones, as written tables."""
    centres = postings.groupBy("token").agg(F.min("node").alias("centre"))
    found = components(postings.join(centres, "token").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    rows = keyed_join(postings.select("node", "n").distinct(), found.withColumnRenamed("component", "cluster"), ["node"], "inner")
    rows = cut(rows, "clusters")
    size = rows.groupBy("cluster").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("nodes"))
    large = cut(size.filter((F.col("tokens") > CLUSTER_TOKENS) | (F.col("nodes") > CLUSTER_NODES)).select("cluster"), "large-clusters")
    small = keyed_join(rows, large, ["cluster"], "left_anti").select("cluster", "node")
    return small, cut(keyed_join(rows, large, ["cluster"], "left_semi").select("node"), "large-nodes")


def _labels(postings: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame | None:
    """node and component of every linked node; None if no two nodes share a prefix token."""
    if postings.isEmpty():
        return None
    small, large = clusters_of(postings)
    if not large.isEmpty():
        again = regrouped(full, large, num, den)
        others, large = clusters_of(again)
        small = small.unionByName(others)
    sent = keyed_join(full, cut(small, "small-clusters"), ["node"], "inner")
    labels = cut(sent.groupBy("cluster").applyInPandas(_link_cluster(num, den, TOGETHER), "node long, component long"), "cluster-labels")
    if not large.isEmpty():
        more = Join(cut(keyed_join(again, large, ["node"], "left_semi"), "round-postings"), full, num, den).run()
        labels = labels if more is None else labels.unionByName(more.select("node", "component"))
    return labels


def _joined(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sets, and f1, f2, n, component and component_id of every node."""
    sets = sets_of(docs, size, num, den)
    nodes = cut(sets.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min_by("doc_id", "row").alias("own"), F.count(F.lit(1)).alias("copies")), "nodes")
    postings = postings_of(sets, nodes, num, den)
    wanted = cut(keyed_join(nodes.select("node", "own", "f1", "f2", "n"), postings.select("node").distinct(), ["node"], "left_semi"), "candidates")
    ids = wanted.select(F.col("own").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if wanted.filter("own is null").isEmpty():  # else all texts are cut into sets again
        texts = keyed_join(texts, ids, ["doc_id"], "left_semi")
    full = texts.select("text").mapInArrow(_full_sets(size), "n long, f1 long, f2 long, tokens binary")
    full = cut(keyed_join(full, wanted.select("node", "f1", "f2", "n"), ["f1", "f2", "n"], "inner").dropDuplicates(["node"]).select("node", "n", "tokens"), "full-sets")
    labels = _labels(postings, full, num, den)
    if labels is None:
        return sets, nodes.select("f1", "f2", "n", F.col("node").alias("component"), F.col("least").alias("component_id"))
    rows = keyed_join(nodes, labels, ["node"], "left").withColumn("component", F.coalesce("component", "node"))
    least = rows.groupBy("component").agg(F.min("least").alias("component_id"))
    return sets, rows.join(least, "component").select("f1", "f2", "n", "component", "component_id")


def jaccard_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, whose columns beyond doc_id and text aren't read."""
    sets, named = _joined(docs, size, num, den)
    return sets.join(named, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each component, that of the least doc_id, with its columns as they are; documents without
    words stay.

    Where doc_ids are unique, those to drop are looked up by doc_id. Else rows are told apart by their sets
    too, and one row of each least doc_id and set is kept."""
    named = cut(jaccard_components(docs, size, num, den), "components-of-documents")
    dropped = named.filter("doc_id <> component_id").select("doc_id")
    odd = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("doc_id is null or rows > 1")
    if odd.isEmpty():
        return keyed_join(docs, dropped, ["doc_id"], "left_anti")

    @F.arrow_udf("struct<n:bigint,f1:bigint,f2:bigint>")
    def marks(column: pa.Array) -> pa.Array:
        rows = [(len(t), *prints(t)) for t in token_sets(column, size)]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "f1", "f2"])

    mark = "set_of_row_" + "_".join(docs.columns)  # a name that no column has
    marked = cut(docs.withColumn(mark, marks(F.col("text").cast("string"))), "marked-documents")
    sets, nodes = _joined(docs, size, num, den)
    parts = sets.select("doc_id", "f1", "f2", "n").join(nodes, ["f1", "f2", "n"])
    best = parts.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "f1", "f2", "n")).alias("x")).select(F.col("x.doc_id").alias("best_id"), "x.f1", "x.f2", "x.n")
    on = marked["doc_id"].cast("long").eqNullSafe(best["best_id"]) & (marked[f"{mark}.f1"] == best["f1"]) & (marked[f"{mark}.f2"] == best["f2"]) & (marked[f"{mark}.n"] == best["n"])
    kept = marked.join(best, on, "left_semi").dropDuplicates(["doc_id", mark])
    return kept.unionByName(marked.filter(F.col(f"{mark}.n") == 0)).drop(mark)
