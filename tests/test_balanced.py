"""Nearest neighbours and radius counts against all pairs, on crowds, outliers, equal places and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from upland.operators import balanced


def crowd(n=900, seed=3):
    """A crowded town, one crowded place, a spread of loose rows, and outliers."""
    rng = random.Random(seed)
    rows = [(20 + rng.random() * 0.01, 80 + rng.random() * 0.01) for _ in range(n // 2)]
    rows += [(20.005, 80.005)] * (n // 6)
    rows += [(rng.uniform(8, 37), rng.uniform(68, 97)) for _ in range(n // 3)]
    return rows + [(-60.0, 10.0), (85.0, -170.0), (None, 3.0), (float("nan"), 3.0)]


def frame(spark, rows, key="id"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{key} long, latitude double, longitude double").repartition(5)


def fine(r):
    return r[0] is not None and r[0] == r[0]


def by_hand(points, others, k, exclude_self):
    out = {}
    for i, p in enumerate(points):
        if fine(p):
            d = sorted(((p[0] - o[0]) * (p[0] - o[0]) + (p[1] - o[1]) * (p[1] - o[1]), j) for j, o in enumerate(others) if fine(o) and not (exclude_self and i == j))
            out[i] = d[:k]
    return {i: d for i, d in out.items() if d}


@pytest.mark.parametrize(("k", "exclude_self", "leaf", "unit"), [(1, False, 16, 50), (8, True, 32, 4096), (3, True, 2, 20), (4, False, 4096, 4096)])
def test_nearest_of_a_crowd(spark, k, exclude_self, leaf, unit):
    rows = crowd()
    points = rows if exclude_self else crowd(300, 9)
    got = {}
    for r in balanced.nearest(frame(spark, points), frame(spark, rows, "other_id"), k, exclude_self, leaf, unit).collect():
        got.setdefault(r.id, {})[r.rn] = (r.d2, r.other_id)
    want = by_hand(points, rows, k, exclude_self)
    assert {i: [d[n] for n in sorted(d)] for i, d in got.items()} == want


def test_nearest_of_few_and_none(spark):
    points, one = frame(spark, [(1.0, 1.0), (50.0, 2.0)]), frame(spark, [(3.0, 3.0)], "other_id")
    assert sorted((r.id, r.other_id, r.rn) for r in balanced.nearest(points, one, 5).collect()) == [(0, 0, 1), (1, 0, 1)]
    assert balanced.nearest(points, one.filter("false"), 2).collect() == balanced.nearest(points.filter("false"), one, 2).collect() == []
    names = points.select(F.concat(F.lit("p"), "id").alias("id"), "latitude", "longitude")
    got = balanced.nearest(names, names.withColumnRenamed("id", "other_id"), 1, exclude_self=True).collect()
    assert sorted((r.id, r.other_id) for r in got) == [("p0", "p1"), ("p1", "p0")]


@pytest.mark.parametrize(("radius", "leaf"), [(0.004, 16), (3.0, 8), (3.0, 4096), (400.0, 16), (0.0, 16)])
def test_radius_counts_of_a_crowd(spark, radius, leaf):
    rows, points = crowd(), crowd(200, 7)
    got = {r.id: r.n for r in balanced.radius_count(frame(spark, points), frame(spark, rows), radius, "n", leaf).collect()}
    near = lambda p, o: (p[0] - o[0]) * (p[0] - o[0]) + (p[1] - o[1]) * (p[1] - o[1]) <= radius * radius
    assert got == {i: sum(near(p, o) for o in rows if fine(o)) if fine(p) else 0 for i, p in enumerate(points)}


def test_no_task_gets_the_crowd(spark):
    """Work is dealt in units: none has more than its share of the pairs, though one town holds most of both sides."""
    rows = [r for r in crowd(6000) if fine(r)]
    places = balanced.cut(frame(spark, rows).dropDuplicates(["latitude", "longitude"]), "places")
    tree, leaves = balanced.plane(places, ["id"], None, 64)
    sizes = sorted(r.n for r in leaves.select(F.size("members").alias("n")).collect())
    assert sum(sizes) == places.count() and sizes[-1] <= 4 * 64
    visits = balanced._with_leaf(frame(spark, rows), tree)
    units = balanced.meetings(visits, leaves, 100).select(F.size("points").alias("p"), (F.size("points") * F.size("members")).alias("pairs")).collect()
    assert sum(u.p for u in units) == len(rows)
    assert max(u.pairs for u in units) < 0.05 * sum(u.pairs for u in units)


def test_circles_add_whole_nodes(spark, monkeypatch):
    """Of a wide circle over a crowd only rows at its edge are compared one by one."""
    rows = [(x / 100, y / 100) for x in range(100) for y in range(100)]
    tree, leaves = balanced.plane(frame(spark, rows), ["id"], None, 32)
    import numpy as np

    row, leaf, inside = tree.within(np.array([0.5]), np.array([0.5]), np.array([0.4**2]), True)
    assert inside[0] > 0.6 * 3.1416 * 40**2 and len(leaf) * 64 < 5026
