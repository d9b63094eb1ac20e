"""Points in polygons by cell covers against a ray for every point and polygon."""

import math
import random

import pytest
from pyspark.sql import functions as F

from upland.operators import spatial

RINGS = {
    "round": [(80 + 9 * math.cos(k * math.pi / 900), 28 + 9 * math.sin(k * math.pi / 900)) for k in range(1800)],
    "star": [(80 + r * math.cos(k * math.pi / 6), 28 + r * math.sin(k * math.pi / 6)) for k, r in enumerate([9, 3] * 6)],
    "square on cells": [(70.0, 30.0), (75.0, 30.0), (75.0, 35.0), (70.0, 35.0)],
    "sliver": [(69.0, 20.0), (90.0, 20.4), (69.0, 20.9)],
    "bow": [(70.0, 14.0), (80.0, 24.0), (80.0, 14.0), (70.0, 24.0)],
    "south of the line": [(-3.5, -7.2), (4.1, -1.3), (2.2, 3.9)],
}


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def polygons(spark, names=tuple(RINGS)):
    edges = lambda ring: [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return spark.createDataFrame([(k, edges(RINGS[k])) for k in names], "name string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def points(n=1500):
    rng = random.Random(8)
    corners = [(float(x), float(y)) for x in (70, 75, 80, 84) for y in (14, 20, 28, 30, 35)]
    return corners + [p for ring in RINGS.values() for p in ring[:3]] + [(rng.uniform(66, 92), rng.uniform(12, 39)) for _ in range(n)] + [(rng.uniform(-4, 5), rng.uniform(-8, 4)) for _ in range(100)]


@pytest.mark.parametrize("cell", [1.0, 0.3, 7.0])
def test_against_rays(spark, cell):
    at = points()
    df = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(at)] + [(99999, None, 3.0)], "id long, latitude double, longitude double")
    got = {(r.id, r.name) for r in spatial.in_polygons(df, polygons(spark), cell).select("id", F.col("name")).collect()}
    assert got == {(i, name) for i, (x, y) in enumerate(at) for name, ring in RINGS.items() if inside(x, y, ring)}


def test_cells_inside_have_no_edges(spark):
    """Of a polygon of 1,800 edges a cell gets those near it, and most of its cells none."""
    cells = spatial.cell_cover(polygons(spark, ("round",))).select("odd", (F.size("edges") + F.size("turns")).alias("n")).collect()
    alone = [c for c in cells if c.n == 0]
    assert all(c.odd == 1 for c in alone) and len(alone) > 0.6 * len(cells)
    assert sum(c.n for c in cells) / len(cells) < 0.02 * 1800 and max(c.n for c in cells) < 0.12 * 1800
    plan = spatial.in_polygons(spark.createDataFrame([(1, 2.0, 3.0)], "id long, latitude double, longitude double"), polygons(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "cell_r" in plan
