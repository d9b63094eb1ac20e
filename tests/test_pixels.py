"""Zonal sums by spans against every cell and polygon, and windows of tiles along the curve."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from upland.operators import pixels, raster
from upland.sources.store import new_folder

X0, Y0, STEP = 68.0, 37.5, 0.1


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def band_of(spark, n=9000, seed=1, low=-40, high=260):
    rng = random.Random(seed)
    cells = {(rng.randint(low, high), rng.randint(low, high)): float(rng.choice([1, 5, 5, 99, rng.random()])) for _ in range(n)}
    return cells, spark.createDataFrame([(*k, v) for k, v in cells.items()], "row long, col long, value double").repartition(5)


RINGS = {
    "star": [(80 + r * math.cos(k * math.pi / 6), 28 + r * math.sin(k * math.pi / 6)) for k, r in enumerate([9, 3] * 6)],
    "on centres": [(70.05, 30.05), (75.05, 30.05), (75.05, 35.05), (70.05, 35.05)],
    "sliver": [(69.0, 20.0), (90.0, 20.001), (69.0, 20.04)],
    "bow": [(70.0, 14.0), (80.0, 24.0), (80.0, 14.0), (70.0, 24.0)],
    "off": [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0)],
    "beyond": [(60.0, 30.0), (72.0, 45.0), (100.0, 30.0), (72.0, 12.0)],
}


def zones_of(spark):
    edges = lambda ring: [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return spark.createDataFrame([(k, edges(v)) for k, v in RINGS.items()], "id string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


@pytest.mark.parametrize("spans", [1 << 18, 40])
def test_spans_of_polygons_against_every_cell(spark, spans):
    cells, band = band_of(spark)
    for name, ring in RINGS.items():
        edges = np.array([(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)])
        keep, pixels.SPANS = pixels.SPANS, spans
        try:
            got = {(r, c) for row, a, b in pixels.spans_of(edges, X0, Y0, STEP) for r, i, j in zip(row.tolist(), a.tolist(), b.tolist(), strict=True) for c in range(i, j + 1)}
        finally:
            pixels.SPANS = keep
        near = {(r, c) for r in range(-80, 320, 3) for c in range(-90, 340)}
        assert got & near == {(r, c) for r, c in near if inside(X0 + (c + 0.5) * STEP, Y0 - (r + 0.5) * STEP, ring)}, name
    if spans > 1000:
        got = {r.id: (r["mean"], r.share) for r in raster.zonal_polygons(zones_of(spark), band, X0, Y0, STEP, 99.0, 5.0).collect()}
        for name, ring in RINGS.items():
            own = [v for (r, c), v in cells.items() if v != 99 and inside(X0 + (c + 0.5) * STEP, Y0 - (r + 0.5) * STEP, ring)]
            assert got[name] == ((None, None) if not own else (pytest.approx(np.mean(own)), pytest.approx(own.count(5.0) / len(own)))), name


def test_boxes_against_every_cell(spark):
    cells, band = band_of(spark)
    rng = random.Random(4)
    boxes = [(i, r, r + rng.randint(-1, 150), c, c + rng.randint(0, 150)) for i in range(40) for r, c in [(rng.randint(-60, 250), rng.randint(-60, 250))]]
    zones = spark.createDataFrame(boxes, "id long, r0 long, r1 long, c0 long, c1 long")
    got = {r.id: (r["mean"], r.share) for r in raster.zonal(zones, band, 99.0, 5.0).collect()}
    for i, r0, r1, c0, c1 in boxes:
        own = [v for (r, c), v in cells.items() if v != 99 and r0 <= r <= r1 and c0 <= c <= c1]
        assert got[i] == ((None, None) if not own else (pytest.approx(np.mean(own)), pytest.approx(own.count(5.0) / len(own))))


def test_no_cell_meets_a_polygon(spark):
    """What is joined are tiles and packed spans: their number follows the zones' tiles, not their cells."""
    _, band = band_of(spark)
    spans = pixels.zone_spans(zones_of(spark), X0, Y0, STEP)
    tiles = pixels.summed_tiles(band, 99.0, 5.0)
    assert tiles.count() <= 36 and spans.count() < 120
    plan = pixels.zonal_sums(spans, tiles)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_tile_meets_zones_in_units(spark):
    """Spans outnumber the zones whose size Spark knows, so they are never broadcast, and many zones take a tile once."""
    cells, band = band_of(spark)
    zones = spark.range(600).select("id", (F.col("id") % 70).alias("r0"), (F.col("id") % 70 + 20).alias("r1"), F.lit(3).alias("c0"), F.lit(90).alias("c1"))
    spans, tiles = pixels.box_spans(zones), pixels.summed_tiles(band, 99.0, 5.0)
    found = pixels.zonal_sums(spans, tiles)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    few = {r.id: (r["mean"], r.share) for r in pixels.zonal_sums(spans, tiles, unit=500).collect()}
    assert few == {r.id: (pytest.approx(r["mean"]), r.share) for r in found.collect()} and len(few) == 600
    own = [v for (r, c), v in cells.items() if v != 99 and 69 <= r <= 89 and 3 <= c <= 90]
    assert few[69] == (pytest.approx(np.mean(own)), pytest.approx(own.count(5.0) / len(own)))


def test_the_curve_and_its_runs():
    r, c = np.array([-5, 0, 3, 900, -1]), np.array([7, 0, -3, 12, -1])
    assert len(set(pixels.curve(r, c).tolist())) == 5
    side = np.arange(-40, 40)
    rows, cols = (x.ravel() for x in np.meshgrid(side, side))
    z = pixels.curve(rows, cols)
    for window in ((-7, 9, -3, 20), (0, 0, 0, 0), (-40, 39, -40, 39), (5, 6, -30, 30)):
        runs = pixels.runs_of(*window)
        held = np.zeros(len(z), bool)
        for a, b in runs:
            held |= (z >= a) & (z <= b)
        want = (rows >= window[0]) & (rows <= window[1]) & (cols >= window[2]) & (cols <= window[3])
        assert len(runs) <= pixels.RUNS and (held | ~want).all()
        assert held.sum() <= 3 * want.sum() + 8


def rows_read(df) -> int:
    """Rows that the scan handed on, after row groups were skipped."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()

    def scans(node):
        if node.nodeName().startswith("Scan") or "ColumnarToRow" not in node.nodeName() and node.children().isEmpty():
            yield node
        kids = node.children()
        for i in range(kids.size()):
            yield from scans(kids.apply(i))

    return sum(n.metrics().get("numOutputRows").get().value() for n in scans(plan) if n.metrics().contains("numOutputRows"))


def test_a_window_reads_few_row_groups(spark):
    band = spark.range(0, 256 * 256).select((F.col("id") / 256).cast("long").alias("row"), (F.col("id") % 256).alias("col"), F.rand(3).alias("value"))
    folder = new_folder(spark, "tiles")
    pixels.write_tiles(raster.to_tiles(band, 4), folder, files=4, group_bytes=1 << 12)
    whole = spark.read.parquet(folder)
    assert whole.count() == 64 * 64
    got = pixels.read_window(spark, folder, 100, 119, 40, 63, size=4)
    assert {(r.tile_r, r.tile_c) for r in got.collect()} == {(r, c) for r in range(25, 30) for c in range(10, 16)}
    assert 30 <= rows_read(got) < 0.25 * 64 * 64
    cells = raster.from_tiles(got, 4)
    assert cells.count() == 20 * 24 and cells.join(band, ["row", "col"]).filter(cells["value"] != band["value"]).isEmpty()
