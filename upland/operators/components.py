"""Connected components of an edge table: forests within tasks, then stars between them.

1. Every task joins the edges of its own partition into a forest and passes on one edge from each node to its tree's
   least node. Nothing is shuffled, and what a task holds is bounded: a forest of HELD nodes is passed on and a new
   one begun.
2. If the edges left are at most TASK, one more task joins them: small graphs take two jobs, however long their chains.
3. Else a node that one forest alone has is set aside; it will get its tree's component. The edges of the others, the
   border between forests, are few where partitions hold what lies together. They go to one task if at most TASK,
   else through alternating large-star and small-star steps: each replaces a node's edges by edges to its least
   neighbour, and the table shrinks towards stars whose centres are the components' least nodes, in about log(n)
   rounds. A round is written to the shared folder, so lineage stays short; only two checksums reach the driver. A
   centre with many edges meets only partial aggregates and joins that AQE can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.sources.store import cut

#: Edges that one task may join at the end, and nodes of a forest that a task holds.
TASK, HELD = 1 << 20, 1 << 20


def least_nodes(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of the nodes 0 to n - 1 reaches by the edges.

    Every node takes its least neighbour's label, labels are followed to their ends, and what is left are edges
    between ends: half of those at least are no local minimum, so it ends after about log(n) turns."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def _star(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
    """An edge from each node of the edges to the least that it reaches, if that is another."""
    both = pa.chunked_array([t.column(c) for c in ("a", "b") for t in tables]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ends = rank[both.indices.to_numpy()]
    half = len(ends) // 2
    label = least_nodes(ends[:half], ends[half:], len(order))
    names, moved = both.dictionary.take(order), np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(label[moved]))], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= 2 * HELD:
            star = _star(held)
            n = star.num_rows
            held = [star]
            if n >= HELD:
                yield star
                held, n = [], 0
    if n:
        yield _star(held)


def _joined(edges: DataFrame) -> DataFrame:
    edges = edges.select("a", "b")
    return edges.mapInArrow(_forests, edges.schema)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(state: DataFrame, rounds: int) -> DataFrame:
    mark = None
    for _ in range(rounds):
        state = cut(_small(_large(state)), "stars")
        new = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return state
        mark = new
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, rounds: int = 60, task: int = TASK) -> DataFrame:
    """node and component (the least node reachable) of every node that has an edge to another.

    `edges` has columns a and b of one type, a number or a string; loops, repeats and both directions are fine, rows
    with a null are no edges."""
    forest = cut(_joined(edges.filter("a <> b")).withColumn("part", F.spark_partition_id()), "forests")
    centres = lambda star: star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    named = lambda star: star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if forest.count() <= task:
        star = cut(_joined(forest.coalesce(1)), "components")
        return named(star).unionByName(centres(star))

    seen = forest.select("a", "part").unionByName(forest.select(F.col("b").alias("a"), "part"))
    shared = seen.groupBy("a").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first <> last").select("a")
    split = cut(forest.join(shared.withColumn("shared", F.lit(True)), "a", "left"), "border")
    border = split.filter("shared").select("a", "b")
    star = cut(_joined(border.coalesce(1)), "components") if border.count() <= task else _stars(border, rounds)
    found = cut(named(star).unionByName(centres(star)), "border-components")
    own = split.filter("shared is null").select(F.col("a").alias("node"), F.col("b").alias("tree"))
    of_tree = found.withColumnsRenamed({"node": "tree", "component": "of_tree"})
    rest = own.join(of_tree, "tree", "left").select("node", F.coalesce("of_tree", "tree").alias("component"))
    alone = own.select(F.col("tree").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(rest).unionByName(alone.withColumn("component", F.col("node")))
