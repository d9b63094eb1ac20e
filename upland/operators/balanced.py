"""Nearest neighbours and counts within a radius by a balanced partition of the plane.

A sample of the others (SAMPLE rows for each leaf) is split at medians, the wider side of a node first, into leaves of
about LEAF rows each, crowded or empty as the plane may be. Then every node gets, from all rows, its exact count and
the tight box around its rows: a pyramid of counts, some dozens of bytes a leaf, which is sent to the tasks.

* Nearest: a point meets the rows of its own leaf; its k-th distance there tells which other leaves could hold a
  nearer row, and it meets those. A leaf of fewer than k rows borrows the distance from the least node above that has
  enough. An outlier so visits the few leaves at the edge of the crowd, not all of it.
* Counts: a node wholly inside the circle adds its count, one wholly outside nothing; what is left at the circle's
  edge are leaves, whose rows are compared one by one.

Others that fit one leaf go to all tasks as they are.

Meetings are dealt out as units of at most about UNIT points and one leaf, so a town that holds most of the points is
many units. Equal places are one place: of the others there, counts have the sum, and the k nearest can only be the
first k + 1 of them. A point or other without coordinates takes no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from upland.operators.topk import first_in_groups
from upland.sources.store import cut

LEAF, SAMPLE, UNIT = 1024, 16, 4096
#: Distances that a kernel holds at once.
CELLS = 1 << 21


class Tree(NamedTuple):
    """A complete binary tree in the order of its levels; node i has the children 2i + 1 and 2i + 2."""

    depth: int
    wide: np.ndarray  # whether an inner node is split by longitude
    split: np.ndarray
    box: np.ndarray  # south, north, west, east of every node; an empty node's is inside out
    count: np.ndarray

    @property
    def first_leaf(self) -> int:
        return (1 << self.depth) - 1

    def leaf_of(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        node = np.zeros(len(lat), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.where(self.wide[node], lon, lat) >= self.split[node])
        return node - self.first_leaf

    def nearest2(self, node: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """The least squared distance that a row of the node can have; no row's is less, in floating point too."""
        south, north, west, east = self.box[node].T
        high, wide = np.maximum(np.maximum(south - lat, lat - north), 0), np.maximum(np.maximum(west - lon, lon - east), 0)
        return high * high + wide * wide

    def farthest2(self, node: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        south, north, west, east = self.box[node].T
        high, wide = np.maximum(np.abs(lat - south), np.abs(lat - north)), np.maximum(np.abs(lon - west), np.abs(lon - east))
        return high * high + wide * wide

    def enough2(self, leaf: np.ndarray, lat: np.ndarray, lon: np.ndarray, k: int) -> np.ndarray:
        """A squared distance within which at least k rows lie; infinite if there aren't as many."""
        node = leaf + self.first_leaf
        for _ in range(self.depth):
            node = np.where(self.count[node] < k, (node - 1) // 2, node)
        return np.where(self.count[node] < k, np.inf, self.farthest2(node, lat, lon))

    def within(self, lat: np.ndarray, lon: np.ndarray, bound: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and leaf of each leaf that reaches into the row's circle, and for each row the count of the nodes that
        lie in it as a whole; these are not followed if `whole`, else nothing is counted so."""
        row, node, inside = np.arange(len(lat)), np.zeros(len(lat), np.int64), np.zeros(len(lat), np.int64)
        for level in range(self.depth + 1):
            meets = self.nearest2(node, lat[row], lon[row]) <= bound[row]
            row, node = row[meets & (self.count[node] > 0)], node[meets & (self.count[node] > 0)]
            if whole:
                full = self.farthest2(node, lat[row], lon[row]) <= bound[row]
                np.add.at(inside, row[full], self.count[node[full]])
                row, node = row[~full], node[~full]
            if level < self.depth:
                row, node = np.repeat(row, 2), np.repeat(2 * node + 1, 2) + np.tile([0, 1], len(node))
        return row, node - self.first_leaf, inside


def splits(lat: np.ndarray, lon: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each inner node whether it is split by longitude, and where: at the sample's median."""
    wide, split = np.zeros((1 << depth) - 1, bool), np.full((1 << depth) - 1, np.inf)
    rows = {0: np.arange(len(lat))}
    for node in range(len(split)):
        own = rows.pop(node, np.zeros(0, np.int64))
        if len(own) > 1:
            wide[node] = np.ptp(lon[own]) > np.ptp(lat[own])
            side = (lon if wide[node] else lat)[own]
            split[node] = np.partition(side, len(side) // 2)[len(side) // 2]
            if split[node] == side.min() and side.max() > split[node]:  # most are in one place: the rest goes right
                split[node] = side[side > split[node]].min()
            right = side >= split[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return wide, split


class Plane(NamedTuple):
    tree: Tree
    leaves: DataFrame  # leaf and its members, sorted


def _with_leaf(rows: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(batch.column("latitude").to_numpy(), batch.column("longitude").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("leaf", LongType())]))


def _placed(rows: DataFrame, *others: str) -> DataFrame:
    at = [F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]
    return rows.select(*others, *at).filter("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)")


def plane(places: DataFrame, own: list[str], count: str | None, leaf: int = LEAF) -> Plane:
    """The partition of `places`, a written table of latitude, longitude and the columns `own`; `count` names the column that
    nodes sum."""
    n = places.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    wanted = max(4096, SAMPLE << depth)
    sample = places.select("latitude", "longitude")
    sample = (sample.sample(wanted / n, 5) if n > wanted else sample).toArrow()
    wide, split = splits(sample["latitude"].to_numpy(), sample["longitude"].to_numpy(), depth)
    empty = Tree(depth, wide, split, np.zeros((0, 4)), np.zeros(0, np.int64))
    total = F.sum(count) if count else F.count(F.lit(1))
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("latitude", "longitude") for f in (F.min, F.max)]
    members = F.sort_array(F.collect_list(F.struct(*own, "latitude", "longitude"))).alias("members")  # about LEAF rows
    leaves = cut(_with_leaf(places, empty).groupBy("leaf").agg(members, total.cast("long").alias("total"), *ends), "leaves")

    found = leaves.drop("members").toArrow()
    box, counts = np.tile([np.inf, -np.inf, np.inf, -np.inf], ((2 << depth) - 1, 1)), np.zeros((2 << depth) - 1, np.int64)
    at = found["leaf"].to_numpy() + empty.first_leaf
    counts[at] = found["total"].to_numpy()
    box[at] = np.stack([found[e].to_numpy() for e in ("min_latitude", "max_latitude", "min_longitude", "max_longitude")], 1)
    for node in range(empty.first_leaf - 1, -1, -1):
        a, b = box[2 * node + 1], box[2 * node + 2]
        box[node] = [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3])]
        counts[node] = counts[2 * node + 1] + counts[2 * node + 2]
    return Plane(Tree(depth, wide, split, box, counts), leaves.select("leaf", "members"))


def meetings(visits: DataFrame, leaves: DataFrame, unit: int = UNIT) -> DataFrame:
    """points (id, latitude, longitude) and members of each unit of work: a leaf, and some of the rows that visit it."""
    load = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / unit).cast("long").alias("units"))
    load = cut(load, "visits-of-leaves")
    dealt = visits.join(load, "leaf").withColumn("unit", F.pmod(F.xxhash64("id", "latitude", "longitude"), "units"))
    packed = dealt.groupBy("leaf", "unit").agg(F.collect_list(F.struct("id", "latitude", "longitude")).alias("points"))
    each = leaves.join(load, "leaf").select("leaf", "members", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("unit"))
    return packed.hint("merge").join(each, ["leaf", "unit"]).select("leaf", "points", "members")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.StructArray, pa.StructArray]]:
    for batch in batches:
        for leaf, points, members in zip(batch.column("leaf").to_pylist(), batch.column("points"), batch.column("members"), strict=True):
            yield leaf, points.values, members.values


def _distances(points: pa.StructArray, members: pa.StructArray) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last point of a band, and their squared distances to all members."""
    a, b = (np.stack([x.field(c).to_numpy() for c in ("latitude", "longitude")]) for x in (points, members))
    step = max(1, CELLS // max(1, len(members)))
    for i in range(0, len(points), step):
        high, wide = (a[k, i : i + step, None] - b[k, None, :] for k in (0, 1))
        yield i, min(i + step, len(points)), high * high + wide * wide


def first_k(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k least finite values, by value and then by column."""
    if d2.shape[1] > k:
        d2 = np.where(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k], d2, np.inf)
    row, column = np.nonzero(d2 < np.inf)
    order = np.lexsort((column, d2[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _structs(places: DataFrame) -> pa.StructArray:
    """All rows of a table that fits a leaf, sorted."""
    table = places.toArrow()
    table = table.sort_by([(c, "ascending") for c in table.column_names])
    return table.combine_chunks().to_struct_array().combine_chunks() if table.num_rows else pa.array([], pa.struct(list(table.schema)))


def _nearest_of_few(rows: DataFrame, few: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """`nearest` among others that fit a leaf."""
    members = _structs(few)
    schema = StructType([rows.schema["id"], few.schema["other_id"], StructField("d2", DoubleType()), StructField("rn", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = members.field("other_id")
        for batch in batches:
            pts, mine = batch.to_struct_array(), batch.column("id")
            for i, j, d2 in _distances(pts, members):
                if exclude_self:
                    d2[mine.to_numpy(zero_copy_only=False)[i:j, None] == theirs.to_numpy(zero_copy_only=False)[None, :]] = np.inf
                row, column = first_k(d2, k)
                place = (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(row + i)), theirs.take(pa.array(column)), pa.array(d2[row, column]), pa.array(place)], names=schema.names)

    return rows.mapInArrow(run, schema)


def nearest(points: DataFrame, others: DataFrame, k: int, exclude_self: bool = False, leaf: int = LEAF, unit: int = UNIT) -> DataFrame:
    """id, other_id, d2 and rn of each point's k nearest others by squared degrees, ties by other_id.

    `others` has other_id, latitude, longitude; with `exclude_self` a point doesn't meet the other of its own id."""
    spark, kept = points.sparkSession, k + exclude_self
    few = first_in_groups(_placed(others, "other_id"), ["latitude", "longitude"], [F.asc("other_id")], kept, "of_place").drop("of_place")
    few, rows = cut(few, "places"), _placed(points, "id")
    if few.count() <= leaf:
        return _nearest_of_few(rows, few, k, exclude_self)
    tree, leaves = plane(few, ["other_id"], None, leaf)
    sent = spark.sparkContext.broadcast(tree)
    own_id, other_id = rows.schema["id"].dataType, few.schema["other_id"].dataType
    double = [StructField(c, DoubleType()) for c in ("latitude", "longitude")]
    #: A pair found, or with a leaf instead of an other a visit that is still to be paid.
    either = StructType([StructField("id", own_id), StructField("other_id", other_id), StructField("d2", DoubleType()), *double, StructField("leaf", LongType())])

    def kernel(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree: Tree = sent.value
            for home, pts, members in _units(batches):
                mine, theirs = (pts.field("id"), members.field("other_id"))
                ids, other_ids = (x.to_numpy(zero_copy_only=False) for x in (mine, theirs))
                for i, j, d2 in _distances(pts, members):
                    if exclude_self:
                        d2[ids[i:j, None] == other_ids[None, :]] = np.inf
                    row, column = first_k(d2, k)
                    n = len(row)
                    none = pa.nulls(n, pa.float64())
                    pairs = [mine.take(pa.array(row + i)), theirs.take(pa.array(column)), pa.array(d2[row, column]), none, none, pa.nulls(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(pairs, names=either.names)
                    if first:
                        lat, lon = (pts.field(c).to_numpy()[i:j] for c in ("latitude", "longitude"))
                        bound = tree.enough2(np.full(j - i, home), lat, lon, kept)
                        full = np.bincount(row, minlength=j - i) == k
                        bound[full] = np.minimum(bound[full], d2[row, column][np.searchsorted(row, np.flatnonzero(full), "right") - 1])
                        at, to, _ = tree.within(lat, lon, bound, False)
                        at, to = at[to != home], to[to != home]
                        n = len(at)
                        visits = [mine.take(pa.array(at + i)), pa.nulls(n, theirs.type), pa.nulls(n, pa.float64()), pa.array(lat[at]), pa.array(lon[at]), pa.array(to)]
                        yield pa.RecordBatch.from_arrays(visits, names=either.names)

        return run

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Visits of the points whose own leaf has no rows: to all leaves that their bound reaches."""
        tree: Tree = sent.value
        for batch in batches:
            leaf, lat, lon = (batch.column(c).to_numpy() for c in ("leaf", "latitude", "longitude"))
            lost = np.flatnonzero(tree.count[leaf + tree.first_leaf] == 0)
            at, to, _ = tree.within(lat[lost], lon[lost], tree.enough2(leaf[lost], lat[lost], lon[lost], kept), False)
            at = lost[at]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(lat[at]), pa.array(lon[at]), pa.array(to)], names=["id", "latitude", "longitude", "leaf"])

    home = cut(_with_leaf(rows, tree), "points")
    met = cut(meetings(home, leaves, unit).mapInArrow(kernel(True), either), "nearest-at-home")
    visits = met.filter("leaf is not null").select("id", "latitude", "longitude", "leaf").unionByName(home.mapInArrow(onward, home.schema))
    more = meetings(cut(visits, "visits"), leaves, unit).mapInArrow(kernel(False), either)
    pairs = met.filter("leaf is null").select("id", "other_id", "d2").unionByName(more.select("id", "other_id", "d2"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("d2", "other_id"))  # k rows for each leaf that a point met
    return pairs.withColumn("rn", place).filter(F.col("rn") <= k)


def radius_count(points: DataFrame, others: DataFrame, radius: float, out: str, leaf: int = LEAF, unit: int = UNIT) -> DataFrame:
    """Points with the number of others within `radius` degrees, 0 included; ids are distinct."""
    spark = points.sparkSession
    places = cut(_placed(others).groupBy("latitude", "longitude").agg(F.count(F.lit(1)).alias("here")), "places")
    rows, number = _placed(points, "id"), StructField("n", LongType())

    def count(pts: pa.StructArray, members: pa.StructArray) -> Iterator[pa.RecordBatch]:
        here = members.field("here").to_numpy()
        for i, j, d2 in _distances(pts, members):
            n = ((d2 <= radius * radius) * here).sum(1)
            yield pa.RecordBatch.from_arrays([pts.field("id").slice(i, j - i), pa.array(n.astype(np.int64))], names=["id", "n"])

    if places.count() <= leaf:
        members = _structs(places)
        few = rows.mapInArrow(lambda batches: (out for b in batches for out in count(b.to_struct_array(), members)), StructType([rows.schema["id"], number]))
        return points.hint("merge").join(few.withColumnRenamed("n", out), "id", "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))

    tree, leaves = plane(places, ["here"], "here", leaf)
    sent = spark.sparkContext.broadcast(tree)
    schema = StructType([*rows.schema.fields, StructField("leaf", LongType()), number])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = sent.value
        for batch in batches:
            lat, lon = (batch.column(c).to_numpy() for c in ("latitude", "longitude"))
            row, to, inside = tree.within(lat, lon, np.full(len(lat), radius * radius), True)
            full = np.flatnonzero(inside)
            at = pa.array(np.concatenate([row, full]))
            leaf, n = pa.array([*to.tolist(), *[None] * len(full)], pa.int64()), pa.array([*[None] * len(row), *inside[full].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], leaf, n], names=schema.names)

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pts, members in _units(batches):
            yield from count(pts, members)

    found = cut(rows.mapInArrow(descend, schema), "circles")
    edge = meetings(found.filter("leaf is not null").drop("n"), leaves, unit)
    both = found.filter("leaf is null").select("id", "n").unionByName(edge.mapInArrow(border, StructType([rows.schema["id"], number])))
    counted = both.groupBy("id").agg(F.sum("n").alias(out))
    return points.hint("merge").join(counted, "id", "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))
