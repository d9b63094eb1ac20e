"""Rasters as long tables of (band, row, col, value): sampling, indices, composites, masks, zonal statistics, mosaics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.operators import pixels
from upland.sources.store import cut


def sample(points: DataFrame, band: DataFrame, x0: float, y0: float, step: float, nodata: float, scale: float = 1.0) -> DataFrame:
    """id and the value of the cell below each point; null off the raster and at nodata. Rows count down from y0."""
    at = points.select("id", F.floor((F.lit(y0) - F.col("latitude")) / step).cast("long").alias("row"), F.floor((F.col("longitude") - F.lit(x0)) / step).cast("long").alias("col"))
    return at.join(band, ["row", "col"], "left").select("id", F.when(F.col("value") != nodata, F.col("value") * scale).alias("value"))


def normalised_difference(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + F.lit(1e-10))


def optical_composite(scenes: DataFrame) -> DataFrame:
    """Median indices of each cell over its scenes whose reflectances (digital numbers / 10000) all lie in (0.01, 1.5)."""
    bands = {b: F.col(b) / 10000.0 for b in ("b04", "b08", "b11")}
    valid = F.lit(True)
    for v in bands.values():
        valid &= (v > 0.01) & (v < 1.5)
    ndbi, ndvi = normalised_difference(bands["b11"], bands["b08"]), normalised_difference(bands["b08"], bands["b04"])
    return scenes.groupBy("cell", "row", "col").agg(F.median(F.when(valid, ndbi)).alias("ndbi"), F.median(F.when(valid, ndvi)).alias("ndvi"))


def radar_composite(scenes: DataFrame, most_null: float = 0.95) -> DataFrame:
    """Median decibels of each cell; values outside (-35, 5) are masked, scenes masked beyond `most_null` left out."""
    value = F.col("value")
    db = F.when(F.col("is_grd"), F.log10(value + 1e-6) * 20.0 - 83.0).otherwise(F.log10(value + 1e-10) * 10.0)
    rows = scenes.withColumn("db", db).withColumn("db", F.when((F.col("db") > -35) & (F.col("db") < 5), F.col("db")))
    used = rows.groupBy("cell", "scene").agg(F.avg(F.col("db").isNull().cast("double")).alias("masked")).filter(F.col("masked") <= most_null).select("cell", "scene")
    return rows.join(used, ["cell", "scene"], "left_semi").groupBy("cell", "row", "col").agg(F.median("db").alias("db"))


def zonal_polygons(zones: DataFrame, band: DataFrame, x0: float, y0: float, step: float, nodata: float, klass: float) -> DataFrame:
    """id, mean and share of class `klass` of the cells whose centres lie in each zone's edges (x1, y1, x2, y2)."""
    found = pixels.zonal_sums(cut(pixels.zone_spans(zones, x0, y0, step), "spans"), pixels.summed_tiles(band, nodata, klass))
    return zones.select("id").join(found, "id", "left")


def zonal(zones: DataFrame, band: DataFrame, nodata: float, klass: float) -> DataFrame:
    """id, mean and share of class `klass` of the cells in each zone's rows r0..r1 and columns c0..c1."""
    found = pixels.zonal_sums(pixels.box_spans(zones), pixels.summed_tiles(band, nodata, klass))
    return zones.select("id").hint("merge").join(found, "id", "left")


def mosaic(tiles: DataFrame, nodata: float) -> DataFrame:
    """The first valid value of each cell in the order of tiles."""
    valid = F.when(F.col("value") != nodata, F.struct("tile", "value"))
    return tiles.groupBy("row", "col").agg(F.min(valid)["value"].alias("value"))


def to_tiles(band: DataFrame, size: int = 64) -> DataFrame:
    """tile_r, tile_c and pixels of square tiles, row by row; a cell without a row in the band is null."""
    return pixels.filled_tiles(band, size)


def from_tiles(tiles: DataFrame, size: int = 64) -> DataFrame:
    """row, col and value of the cells that are there."""
    cells = tiles.select("tile_r", "tile_c", F.posexplode("pixels").alias("at", "value")).filter("value is not null")
    row = F.col("tile_r") * size + (F.col("at") / size).cast("long")
    return cells.select(row.alias("row"), (F.col("tile_c") * size + F.col("at") % size).alias("col"), "value")


def grid_cells(south: float, west: float, north: float, east: float, step: float) -> list[tuple[float, float, float, float]]:
    """West, south, east and north of the cells of an extent; those at its edge are clipped."""
    rows, cols = math.ceil((north - south) / step - 1e-9), math.ceil((east - west) / step - 1e-9)
    return [
        tuple(round(v, 4) for v in (west + c * step, south + r * step, min(west + (c + 1) * step, east), min(south + (r + 1) * step, north)))
        for r in range(rows)
        for c in range(cols)
    ]


def in_tiles(points: DataFrame, tiles: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Points with each tile whose bounds, widened by `margin`, hold them; tiles have tile, south and west.

    A point is dealt to the lattice cells that its margin touches, so the join is on the cell."""
    marks = [F.floor((F.col(c) + s * margin) / size).cast("long") for c in ("latitude", "longitude") for s in (-1, 1)]
    cells = [F.explode(F.sequence(marks[0], marks[1])).alias("cell_r"), F.sequence(marks[2], marks[3]).alias("cols")]
    dealt = points.select("*", *cells).withColumn("cell_c", F.explode("cols")).drop("cols")
    at = tiles.withColumns({"cell_r": F.floor(F.col("south") / size).cast("long"), "cell_c": F.floor(F.col("west") / size).cast("long")})
    return dealt.join(at, ["cell_r", "cell_c"]).drop("cell_r", "cell_c")


def tile_name(lat: Column, lon: Column, size: int = 3) -> Column:
    """Name of the tile's south-west corner, as N27E081."""
    south, west = (F.floor(lat / size) * size).cast("int"), (F.floor(lon / size) * size).cast("int")
    side = lambda v, plus, minus, n: F.concat(F.when(v >= 0, plus).otherwise(minus), F.lpad(F.abs(v).cast("string"), n, "0"))
    return F.concat(side(south, "N", "S", 2), side(west, "E", "W", 3))


def autoscaled(df: DataFrame, column: str, above: float = 2.0, by: float = 10000.0) -> DataFrame:
    """Divide a column whose maximum shows that it holds scaled integers."""
    top = df.agg(F.max(column).alias("top_of_column"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("top_of_column") > above, F.col(column) / by).otherwise(F.col(column))).drop("top_of_column")  # one row
