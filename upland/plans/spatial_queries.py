"""Queries of spatial joins, distances, polygons and duplicate collapsing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.functions import spatial as sp
from upland.operators import scoring, spatial
from upland.plans import oracle as o
from upland.plans.features import grown, rounded
from upland.sources import panel as src
from upland.sources.store import cut

RADIUS = 1.5
#: Rectangles and one concave polygon on the coordinate square: name and ring of (x, y).
POLYGONS = {
    "east": [(84.0, 8.0), (97.5, 8.0), (97.5, 37.5), (84.0, 37.5)],
    "south": [(68.0, 8.0), (90.0, 8.0), (90.0, 16.0), (68.0, 16.0)],
    "notched": [(70.0, 20.0), (82.0, 20.0), (82.0, 34.0), (76.0, 25.0), (70.0, 34.0)],
}


def edges_of(ring: list[tuple[float, float]]) -> list[dict[str, float]]:
    return [{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def polygons(spark: SparkSession) -> DataFrame:
    rows = [(name, edges_of(ring)) for name, ring in POLYGONS.items()]
    return spark.createDataFrame(rows, "name string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")


def radius_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spatial.radius_count(src.entities(spark, sf_dir), src.towers(spark, sf_dir), RADIUS, "towers")
    return counted.select("id", "towers", F.round(F.col("towers") / F.lit(math.pi * 25), 6).alias("tower_density"))


def nearest_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.nearest(src.entities(spark, sf_dir), src.cities(spark, sf_dir).withColumnRenamed("city_id", "other_id"), 1)
    return near.select("id", F.col("other_id").alias("city_id"), F.round(F.sqrt("d2") * 111.0, 6).alias("dist_city_km"))


def knn_spatial_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cut(grown(spark, sf_dir).select("id", "latitude", "longitude", "ntl_growth_log"), "points")
    return rounded(spatial.spatial_lag(points, "ntl_growth_log", 10), "spatial_lag")


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_polygons(src.entities(spark, sf_dir), polygons(spark))


def polygon_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with the first polygon that holds it, or null."""
    return spatial.first_polygon(src.entities(spark, sf_dir).select("id", "latitude", "longitude"), polygons(spark)).select("id", "name")


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.named_pairs(src.entities(spark, sf_dir), scoring.base_name(F.col("village_name")), 100.0)
    return rounded(pairs, "km")


def name_radius_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity of each group of one name within 100 km, the one with the best growth."""
    rows = cut(grown(spark, sf_dir).select("id", "village_name", "latitude", "longitude", "ntl_growth_log"), "grown")
    linked = spatial.named_links(rows, scoring.base_name(F.col("village_name")), 100.0)
    best = [F.round(F.coalesce("ntl_growth_log", F.lit(-1.0)), 9).desc(), F.col("id").asc()]
    return scoring.keep_best_linked(rows, *linked, best).select("id", "village_name")


def near_duplicate_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity of each chain of entities within 0.3 degrees, the one with the longest name."""
    rows = src.entities(spark, sf_dir)
    return scoring.keep_best_linked(rows, *spatial.radius_links(rows, 0.3), [F.length("village_name").desc(), F.col("id").asc()]).select("id", "village_name")


def planar_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haversine of each entity to a fixed point."""
    rows = src.entities(spark, sf_dir)
    return rows.select("id", F.round(sp.haversine(F.col("latitude"), F.col("longitude"), F.lit(22.0), F.lit(79.0)), 6).alias("km"))


QUERIES = {f.__name__: f for f in (radius_count, nearest_city, knn_spatial_lag, point_in_polygon, polygon_fill, haversine_pairs, name_radius_dedup, near_duplicate_radius, planar_distance)}


def _inside(ring: list[tuple[float, float]]) -> str:
    cross = [f"(({e['y1']} > latitude) <> ({e['y2']} > latitude) AND longitude < ({e['x2']}::DOUBLE - {e['x1']}::DOUBLE) * (latitude - {e['y1']}::DOUBLE) / nullif({e['y2']}::DOUBLE - {e['y1']}::DOUBLE, 0) + {e['x1']}::DOUBLE)" for e in edges_of(ring)]
    return f"({' + '.join(f'coalesce({c}, false)::INT' for c in cross)}) % 2 = 1"


_PIP = " UNION ALL ".join(f"SELECT id, '{name}' AS name FROM entity WHERE {_inside(ring)}" for name, ring in POLYGONS.items())
_BASE = r"lower(trim(regexp_replace(village_name, '\s*\(OSM\s*\d+\)\s*$', '')))"
_CC = """both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, a FROM pairs UNION SELECT b, b FROM pairs), reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, p.b FROM reach r JOIN both_ways p ON r.b = p.a),
  comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""


def name_key_sql() -> str:
    return _BASE


def components_sql(name: str) -> str:
    """The components of the table {name}_pairs, as {name}_comp."""
    return _CC.replace("FROM pairs", f"FROM {name}_pairs").replace("both_ways", f"{name}_both").replace("reach", f"{name}_reach").replace("comp AS", f"{name}_comp AS")


ORACLE_SQL = {
    "radius_count": f"WITH {o.ENTITY}, {o.TOWERS} SELECT a.id, count(b.tower_id) AS towers, round(count(b.tower_id) / (pi() * 25), 6) AS tower_density FROM entity a LEFT JOIN towers b ON {o.D2} <= {RADIUS * RADIUS} GROUP BY a.id",
    "nearest_city": f"WITH {o.ENTITY}, {o.CITIES}, d AS (SELECT a.id, b.city_id, {o.D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {o.D2}, b.city_id) AS rn FROM entity a CROSS JOIN cities b) SELECT id, city_id, round(sqrt(d2) * 111.0, 6) AS dist_city_km FROM d WHERE rn = 1",
    "knn_spatial_lag": f"WITH {o.GROWN}, p AS (SELECT id, latitude, longitude, coalesce(ntl_growth_log, 0) AS v FROM grown), d AS (SELECT a.id, b.v, row_number() OVER (PARTITION BY a.id ORDER BY {o.D2}, b.id) AS rn FROM p a JOIN p b ON a.id <> b.id) SELECT id, round(avg(v), 6) AS spatial_lag FROM d WHERE rn <= 10 GROUP BY id",
    "point_in_polygon": f"WITH {o.ENTITY} {_PIP}",
    "polygon_fill": f"WITH {o.ENTITY}, pip AS ({_PIP}), f AS (SELECT id, min(name) AS name FROM pip GROUP BY id) SELECT e.id, f.name FROM entity e LEFT JOIN f ON e.id = f.id",
    "haversine_pairs": f"WITH {o.ENTITY}, n AS (SELECT *, {_BASE} AS base FROM entity) SELECT a.id AS a, b.id AS b, round({o.HAVERSINE}, 6) AS km FROM n a JOIN n b ON a.base = b.base AND a.id < b.id WHERE a.base <> '' AND {o.HAVERSINE} <= 100",
    "name_radius_dedup": f"WITH RECURSIVE {o.GROWN}, n AS (SELECT *, {_BASE} AS base FROM grown), pairs AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.base = b.base AND a.id < b.id WHERE a.base <> '' AND {o.HAVERSINE} <= 100), {_CC}, r AS (SELECT g.id, row_number() OVER (PARTITION BY component ORDER BY round(coalesce(ntl_growth_log, -1), 9) DESC, g.id) AS place FROM grown g JOIN comp c ON g.id = c.id) SELECT id, village_name FROM entity WHERE id NOT IN (SELECT id FROM r WHERE place > 1)",
    "near_duplicate_radius": f"WITH RECURSIVE {o.ENTITY}, pairs AS (SELECT a.id AS a, b.id AS b FROM entity a JOIN entity b ON a.id < b.id WHERE {o.D2} <= 0.09), {_CC}, r AS (SELECT e.id, row_number() OVER (PARTITION BY component ORDER BY length(village_name) DESC, e.id) AS place FROM entity e JOIN comp c ON e.id = c.id) SELECT id, village_name FROM entity WHERE id NOT IN (SELECT id FROM r WHERE place > 1)",
    "planar_distance": f"WITH {o.ENTITY}, b AS (SELECT 22.0::DOUBLE AS latitude, 79.0::DOUBLE AS longitude) SELECT a.id, round({o.HAVERSINE}, 6) AS km FROM entity a CROSS JOIN b",
}
