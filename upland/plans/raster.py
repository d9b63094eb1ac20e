"""Queries over rasters whose cells are rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.operators import pixels
from upland.operators import raster as r
from upland.plans import oracle as o
from upland.plans.features import rounded
from upland.sources import panel as src
from upland.sources.store import new_folder

NODATA = 65535.0


#: Cells a side of the band on the coordinate square, and their width in degrees.
SIDE, STEP = 1180, 0.025


def band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered quantities on a grid over the coordinate square: a row for each cell that has any; returns are holes."""
    rows = src.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 37 % SIDE).alias("row"), (F.col("l_partkey") * 91 % SIDE).alias("col"), "l_quantity", "l_returnflag")
    whole = F.when(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)) == 1, F.lit(NODATA)).otherwise(F.sum(F.col("l_quantity").cast("double")))
    return rows.groupBy("row", "col").agg(whole.alias("value"))


def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.sample(src.entities(spark, sf_dir), band(spark, sf_dir), 68.0, 37.5, STEP, NODATA, 0.01), "value")


def raster_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of the band, read from tiles that lie along the curve."""
    folder = new_folder(spark, "tiles")
    pixels.write_tiles(r.to_tiles(band(spark, sf_dir)), folder)
    cells = r.from_tiles(pixels.read_window(spark, folder, 300, 420, 700, 790))
    return cells.filter("row between 300 and 420 and col between 700 and 790")


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels of scenes: a scene for each line number of a supplier's cell, a pixel for each part."""
    n = lambda c, m, add: (F.col(c) % m + add).cast("double")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")
    lines = src.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey", "l_returnflag", cents, (F.col("l_orderkey") * 104729).alias("o"), (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 31).alias("q"))
    place = {"cell": F.col("l_suppkey") % 4, "scene": F.col("l_linenumber"), "row": (F.col("l_partkey") / 40).cast("long"), "col": F.col("l_partkey") % 40}
    return lines.withColumns(place | {"b04": n("cents", 9000, 0), "b08": n("o", 9000, 50), "b11": n("q", 17000, 0), "value": n("q", 1000, 0) / 1000.0, "is_grd": F.col("l_returnflag") == "R"})


def ndbi_median_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.optical_composite(_scenes(spark, sf_dir)), "ndbi", "ndvi")


def sar_db_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _scenes(spark, sf_dir).withColumn("value", F.when(F.col("is_grd"), F.col("value") * 20000).otherwise(F.col("value")))
    return rounded(r.radar_composite(scenes.withColumn("value", F.when((F.col("cell") == 1) & (F.col("scene") == 2), 0.0).otherwise(F.col("value")))), "db")


def zonal_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and class share of a window of the band around each entity."""
    zones = src.entities(spark, sf_dir).select("id", (F.col("id") * 13 % 1140).alias("r0"), (F.col("id") * 29 % 1120).alias("c0")).withColumns({"r1": F.col("r0") + 36, "c1": F.col("c0") + 59})
    return rounded(r.zonal(zones, band(spark, sf_dir), NODATA, 50.0), "mean", "share")


def raster_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid tile's value of each cell; a tile for each line number, a cell for each part."""
    lines = src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("tile"), "l_partkey").agg(F.sum(F.col("l_quantity").cast("double")).alias("q"))
    cells = lines.select("tile", (F.col("l_partkey") / 100).cast("long").alias("row"), (F.col("l_partkey") % 100).alias("col"), F.when(F.col("l_partkey") * 7 % 11 + F.col("tile") < 9, NODATA).otherwise(F.col("q")).alias("value"))
    return r.mosaic(cells, NODATA)


def tile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.entities(spark, sf_dir).groupBy(r.tile_name(F.col("latitude"), F.col("longitude")).alias("tile")).agg(F.count(F.lit(1)).alias("entities"))


def unit_autoscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.autoscaled(src.settled(spark, sf_dir).select("id", "ghsl_2015", "ghsl_2020"), "ghsl_2020"), "ghsl_2015", "ghsl_2020")


QUERIES = {f.__name__: f for f in (raster_sample, raster_window, ndbi_median_composite, sar_db_mask, zonal_fraction, raster_mosaic, tile_names, unit_autoscale)}

_BAND = f"""band AS (SELECT l_orderkey * 37 % {SIDE} AS row, l_partkey * 91 % {SIDE} AS col,
  CASE WHEN max((l_returnflag = 'R')::INT) = 1 THEN {NODATA}::DOUBLE ELSE sum(l_quantity::DOUBLE) END AS value FROM lineitem GROUP BY 1, 2)"""
_SCENES = """sc AS (SELECT l_suppkey % 4 AS cell, l_linenumber AS scene, l_partkey // 40 AS row, l_partkey % 40 AS col, (CAST(round(l_extendedprice * 100) AS BIGINT) % 9000)::DOUBLE AS b04,
  (l_orderkey * 104729 % 9000 + 50)::DOUBLE AS b08, ((l_orderkey * 7919 + l_partkey * 31) % 17000)::DOUBLE AS b11, ((l_orderkey * 7919 + l_partkey * 31) % 1000)::DOUBLE / 1000.0::DOUBLE AS value,
  l_returnflag = 'R' AS is_grd FROM lineitem)"""
ORACLE_SQL = {
    "raster_sample": f"WITH {o.ENTITY}, {_BAND}, spot AS (SELECT id, floor((37.5::DOUBLE - latitude) / {STEP}::DOUBLE)::BIGINT AS row, floor((longitude - 68.0::DOUBLE) / {STEP}::DOUBLE)::BIGINT AS col FROM entity) SELECT a.id, round(CASE WHEN value <> {NODATA} THEN value * 0.01::DOUBLE END, 6) AS value FROM spot a LEFT JOIN band b ON a.row = b.row AND a.col = b.col",
    "ndbi_median_composite": f"""WITH {_SCENES}, v AS (SELECT *, b04 / 10000 BETWEEN 0.0100000001 AND 1.4999999 AND b08 / 10000 BETWEEN 0.0100000001 AND 1.4999999 AND b11 / 10000 BETWEEN 0.0100000001 AND 1.4999999 AS ok, b04 / 10000.0::DOUBLE AS r, b08 / 10000.0::DOUBLE AS n, b11 / 10000.0::DOUBLE AS s FROM sc)
      SELECT cell, row, col, round(median(CASE WHEN ok THEN (s - n) / (s + n + 1e-10) END), 6) AS ndbi, round(median(CASE WHEN ok THEN (n - r) / (n + r + 1e-10) END), 6) AS ndvi FROM v GROUP BY cell, row, col""",
    "sar_db_mask": f"""WITH {_SCENES}, w AS (SELECT * REPLACE (CASE WHEN cell = 1 AND scene = 2 THEN 0 WHEN is_grd THEN value * 20000 ELSE value END AS value) FROM sc), d AS (SELECT *, CASE WHEN is_grd THEN log10(value + 1e-6) * 20 - 83 ELSE log10(value + 1e-10) * 10 END AS d0 FROM w),
      m AS (SELECT *, CASE WHEN d0 > -35 AND d0 < 5 THEN d0 END AS db FROM d), u AS (SELECT cell, scene FROM m GROUP BY 1, 2 HAVING avg((db IS NULL)::INT) <= 0.95) SELECT m.cell, row, col, round(median(db), 6) AS db FROM m JOIN u ON m.cell = u.cell AND m.scene = u.scene GROUP BY m.cell, row, col""",
    "raster_window": f"WITH {_BAND} SELECT row, col, value FROM band WHERE row BETWEEN 300 AND 420 AND col BETWEEN 700 AND 790",
    "zonal_fraction": f"""WITH {o.ENTITY}, {_BAND}, z AS (SELECT id, id * 13 % 1140 AS r0, id * 29 % 1120 AS c0 FROM entity), b AS (SELECT row, col, value FROM band WHERE value <> {NODATA}),
      f AS (SELECT z.id, avg(value) AS mean, avg((value = 50)::INT) AS share FROM z JOIN b ON row BETWEEN r0 AND r0 + 36 AND col BETWEEN c0 AND c0 + 59 GROUP BY z.id)
      SELECT z.id, round(mean, 6) AS mean, round(share, 6) AS share FROM z LEFT JOIN f ON z.id = f.id""",
    "raster_mosaic": f"""WITH t AS (SELECT l_linenumber AS tile, l_partkey // 100 AS row, l_partkey % 100 AS col, CASE WHEN l_partkey * 7 % 11 + l_linenumber < 9 THEN {NODATA} ELSE sum(l_quantity::DOUBLE) END AS value
      FROM lineitem GROUP BY l_linenumber, l_partkey) SELECT row, col, min_by(value, tile) FILTER (WHERE value <> {NODATA}) AS value FROM t GROUP BY row, col""",
    "tile_names": f"WITH {o.ENTITY} SELECT 'N' || lpad((floor(latitude / 3) * 3)::INT::VARCHAR, 2, '0') || 'E' || lpad((floor(longitude / 3) * 3)::INT::VARCHAR, 3, '0') AS tile, count(*) AS entities FROM entity GROUP BY 1",
    "unit_autoscale": f"WITH {o.CHANGES}, t AS (SELECT max(ghsl_2020) AS m FROM ghsl) SELECT id, round(ghsl_2015, 6) AS ghsl_2015, round(CASE WHEN m > 2 THEN ghsl_2020 / 10000 ELSE ghsl_2020 END, 6) AS ghsl_2020 FROM ghsl CROSS JOIN t",
}
