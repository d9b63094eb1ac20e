"""Queries of sources, sinks, predicates on raw tables, and merges of what arrives in parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upland.functions import series
from upland.operators import raster, scoring, serving, spatial, validation
from upland.plans import oracle as o
from upland.plans.features import ORACLE_SQL as FEATURE_SQL
from upland.plans.features import ensemble, grown, rounded, scored, shortlist
from upland.plans.spatial_queries import POLYGONS, polygons
from upland.sources import catalogue, files, geometry, grids, jsonsource
from upland.sources import panel as src
from upland.sources.store import cut, new_folder
from upland.streaming import incremental

#: Rural households with electricity in 2011, by state, in per cent (fixed values).
ACCESS_2011 = {
    "Himachal Pradesh": 98.5, "Kerala": 98.0, "Punjab": 97.0, "Goa": 96.0, "Tamil Nadu": 94.5, "Haryana": 91.3,
    "Andhra Pradesh": 87.6, "Uttarakhand": 85.7, "Gujarat": 84.3, "Karnataka": 83.1, "Maharashtra": 77.8,
    "Rajasthan": 67.9, "Madhya Pradesh": 67.2, "West Bengal": 66.3, "Odisha": 60.5, "Uttar Pradesh": 48.4,
    "Jharkhand": 46.5, "Assam": 42.5, "Chhattisgarh": 68.7, "Bihar": 16.4,
}
ENTITY_DDL = "id string, village_name string, state_name string, latitude double, longitude double"


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.entities(spark, sf_dir)
    return rows.select(F.col("id").cast("string"), "village_name", "state_name", "latitude", "longitude")


# Sources and sinks


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities through CSV; the first of the paths isn't there, so the second is read."""
    folder = new_folder(spark, "csv")
    files.write_csv(_strings(spark, sf_dir), folder)
    found = files.read_csv(spark, [new_folder(spark, "absent"), folder], StructType.fromDDL(ENTITY_DDL))
    return rounded(found, "latitude", "longitude")


def csv_sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage over the first 5,000 rows of the panel, as a quick report takes it."""
    rows = src.panel(spark, sf_dir).orderBy("id").limit(5000)
    return rounded(serving.coverage(rows, ["ntl_2019", "built_2020", "ghsl_2015"]), "share")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "json")
    files.write_json(_strings(spark, sf_dir), folder)
    return rounded(spark.read.schema(ENTITY_DDL).json(folder), "latitude", "longitude")


def wkb_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points through a Parquet column of well-known binary."""
    rows = src.entities(spark, sf_dir).select("id", geometry.to_wkb(F.col("longitude"), F.col("latitude")).alias("wkb"))
    back = cut(rows, "wkb").select("id", geometry.from_wkb(F.col("wkb"))[0][0].alias("p"))
    return rounded(back.select("id", F.col("p.x").alias("longitude"), F.col("p.y").alias("latitude")), "longitude", "latitude")


def gpkg_layer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's wanted columns and places, from a GeoPackage for each state."""
    points = src.entities(spark, sf_dir).select("id", "village_name", "state_name", "district_name", "longitude", "latitude")
    packages = cut(geometry.write_packages(points, "state_name", "villages"), "packages")
    rows = geometry.read_layer(packages, "villages", {"id": "long", "village_name": "string"})
    at = F.col("rings")[0][0]
    return rounded(rows.select("id", "village_name", at["x"].alias("longitude"), at["y"].alias("latitude")), "longitude", "latitude")


def _element(key: str, lat: int, lon: int, **tags: Column) -> Column:
    latitude, longitude = src.place(F.col(key), lat, lon)
    entries = F.array(*[F.struct(F.lit(k.replace("__", ":")).alias("key"), v.alias("value")) for k, v in tags.items()])
    there = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return F.struct(F.col(key).alias("id"), latitude.alias("lat"), longitude.alias("lon"), there.alias("tags"))


def json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a document for each state, with the first name that isn't empty and the number of tags."""
    part = src.table(spark, sf_dir, "part")
    blank = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name"))
    tags = {
        "name": F.when(F.col("p_partkey") % 3 != 0, blank),
        "name__hi": F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_name"), F.lit("-local"))),
        "is_in__state": F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")),
    }
    documents = cut(jsonsource.bodies(part, "p_brand", _element("p_partkey", 7919, 104729, **tags)), "bodies")
    return rounded(jsonsource.elements(documents), "lat", "lon")


def json_towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = src.table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("kind"), (F.col("s_suppkey") % 4).cast("string")))
    documents = cut(jsonsource.bodies(supplier, "s_nationkey", _element("s_suppkey", 6007, 15013, tower__type=kind)), "bodies")
    return rounded(jsonsource.towers(documents), "lat", "lon")


def json_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vertex of a road for each region, whose vertices are the region's suppliers."""
    supplier = src.table(spark, sf_dir, "supplier").join(src.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lat, lon = src.place(F.col("s_suppkey"), 6007, 15013)
    ordered = F.array_sort(F.collect_list(F.struct("s_suppkey", lat.alias("lat"), lon.alias("lon"))))
    line = F.transform(ordered, lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon")))
    roads = supplier.groupBy("n_regionkey").agg(line.alias("geometry"))
    one = F.array(F.struct(F.col("n_regionkey").alias("id"), "geometry"))
    rows = jsonsource.every_nth_vertex(roads.select(F.to_json(F.struct(one.alias("elements"))).alias("body")))
    return rounded(rows.select("id", F.col("k").cast("long"), "lat", "lon"), "lat", "lon")


def json_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stand under records, data or result.records, whichever a document has."""
    nation = src.table(spark, sf_dir, "nation")
    row = F.array(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))
    kinds = [F.struct(row.alias("records")), F.struct(row.alias("data")), F.struct(F.struct(row.alias("records")).alias("result"))]
    bodies = [F.to_json(k) for k in kinds]
    body = F.when(F.col("n_nationkey") % 3 == 0, bodies[0]).when(F.col("n_nationkey") % 3 == 1, bodies[1]).otherwise(bodies[2])
    return jsonsource.records(nation.select(body.alias("body")), "struct<k:int,name:string>")


def literal_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of the literal table with the customers that fall to each by their number."""
    states = [(i, k, v) for i, (k, v) in enumerate(ACCESS_2011.items())]
    known = spark.createDataFrame(states, "place long, state_name string, access double")
    counts = src.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % len(states)).alias("place")).agg(F.count(F.lit(1)).alias("customers"))
    return known.join(counts, "place", "left").select("state_name", "access", F.coalesce("customers", F.lit(0).cast("long")).alias("customers"))


def binary_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of four grid files, written from order lines and read from their bytes; cells without a line have no data."""

    def file(rows: pd.DataFrame) -> pd.DataFrame:
        k, values = int(rows["tile"].iloc[0]), np.full(30 * 40, np.nan)
        values[rows["cell"]] = rows["value"]
        body = grids.grid_bytes(68.0 + 4 * k, 37.5 - 3 * k, 0.1, values.reshape(30, 40), -999.5)
        return pd.DataFrame({"path": [f"tile{k}"], "content": [body]})

    lines = src.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("tile"), (F.col("l_partkey") % 1200).alias("cell"), "l_quantity")
    cells = lines.groupBy("tile", "cell").agg((F.min(F.col("l_quantity").cast("double")) / 4).alias("value"))  # 1200 a tile at most
    blobs = cells.groupBy("tile").applyInPandas(file, "path string, content binary")
    return rounded(grids.cells(cut(blobs, "grids")), "longitude", "latitude", "value")


def raster_tile_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band through a table of pixel tiles; the band's nodata cells have no row."""
    cells = src.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 300).alias("row"), (F.col("o_custkey") % 200).alias("col"), "o_orderkey")
    band = cells.groupBy("row", "col").agg(F.min("o_orderkey").cast("double").alias("value"))
    return raster.from_tiles(cut(raster.to_tiles(band, 32), "tiles"), 32)


def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media type that an uploaded file of each name gets."""
    endings = F.array(*map(F.lit, ["csv", "json", "html", "tif", "bin"]))
    name = F.concat_ws(".", "p_name", F.get(endings, (F.col("p_partkey") % 5).cast("int")))
    rows = src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("path"))
    return rows.withColumn("content_type", files.content_type(F.col("path")))


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = src.table(spark, sf_dir, "orders")
    lat, lon = src.place(F.col("o_orderkey"), 5003, 13007)
    return orders.select(
        F.concat(F.lit("scene-"), F.col("o_custkey").cast("string")).alias("id"),
        F.col("o_orderkey").alias("key"),
        F.col("o_orderstatus").alias("collection"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_orderkey") * 37 % 100).cast("double").alias("cloud"),
        lat,
        lon,
    )


def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dry-season scenes with little cloud in a box; the first collection has none, so the second answers."""
    found = catalogue.search(_scenes(spark, sf_dir), ["X", "O", "F"], (10.0, 70.0, 30.0, 95.0), [("01-01", "05-31"), ("10-01", "12-31")], 25.0)
    return found.select("id", "key", "collection", F.col("day").cast("string").alias("day"), "cloud")


def season_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped in each quarter, and those within a window that passes the year's end."""
    day = F.col("l_shipdate").cast("date")
    rows = src.table(spark, sf_dir, "lineitem").groupBy(catalogue.season(day).alias("season"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(catalogue.in_window(day, "11-15", "02-10")).alias("winter"))


# Predicates and derived columns


def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("latitude").between(10.0, 30.0) & F.col("longitude").between(70.5, 90.25)
    return src.entities(spark, sf_dir).filter(inside).select("id")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities some of which have a stand-in for a name, or none."""
    stand_in = F.concat(F.lit("Village_"), F.col("id").cast("string"))
    name = F.when(F.col("id") % 7 == 0, stand_in).when(F.col("id") % 11 != 0, F.col("village_name"))
    return src.entities(spark, sf_dir).withColumn("village_name", name)


def named_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("id", "village_name", scoring.unnamed(F.col("village_name")).alias("unnamed"))


def signal_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index changes; there is no radar, so its delta is null."""
    rows = scoring.with_deltas(src.index_panel(spark, sf_dir))
    return rounded(rows.select("id", "ndbi_growth", "ndvi_growth", "s1_vv_delta"), "ndbi_growth", "ndvi_growth", "s1_vv_delta", places=9)


def index_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of the two index series."""
    rows = src.index_panel(spark, sf_dir)
    slopes = {f"{s}_trend_slope": series.trend([f"{s}_{y}" for y in src.YEARS])[0] for s in ("ndbi", "ndvi")}
    return rounded(rows.withColumns(slopes).select("id", *slopes), *slopes, places=9)


def population_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with population and index series, merged by id."""
    rows = src.entities(spark, sf_dir).select("id", "village_name")
    both = rows.join(src.population(spark, sf_dir), "id", "left").join(src.index_panel(spark, sf_dir), "id", "left")
    return rounded(both.select("id", "village_name", "pop_2019", "pop_2020", "pop_growth_rate", "ndbi_2019", "ndvi_2024"), "pop_growth_rate", "ndbi_2019", "ndvi_2024", places=9)


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access by district from a survey whose names are written otherwise."""
    rows = src.entities(spark, sf_dir).filter("id % 3 <> 1")
    return rows.select(
        F.concat(F.upper("state_name"), F.lit(" ")).alias("state"),
        F.replace(F.col("district_name"), F.lit("-"), F.lit(" - ")).alias("district"),
        (F.col("id") * 37 % 1000 / F.lit(10.0)).alias("access"),
    )


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.entities(spark, sf_dir).select("state_name").distinct()
    return rows.withColumn("access", F.substring("state_name", 7, 1).cast("double") * 15)


def _classified(rows: DataFrame) -> DataFrame:
    category = scoring.groundtruth(F.col("access"), F.col("ntl_growth_pct"))
    return rows.select("id", F.round("access", 6).alias("access"), category.alias("category"))


def groundtruth_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(scoring.with_district_access(grown(spark, sf_dir), _survey(spark, sf_dir), _states(spark, sf_dir)))


def groundtruth_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey names no district, so the states' figures stand in."""
    lacking = _survey(spark, sf_dir).drop("district")
    return _classified(scoring.with_district_access(grown(spark, sf_dir), lacking, _states(spark, sf_dir)))


# Places


def polygon_fill_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the entities without one, from the first polygon that holds them."""
    state = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 != 1, F.col("state_name"))
    rows = src.entities(spark, sf_dir).withColumn("state_name", state)
    filled = spatial.fill_blank(rows, polygons(spark), "state_name", scoring.blank(F.col("state_name")))
    return filled.select("id", "state_name")


def highways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth supplier's place, as vertices of roads."""
    return src.towers(spark, sf_dir).filter("tower_id % 5 = 0").withColumnRenamed("tower_id", "other_id")


def city_and_highway(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cut(src.entities(spark, sf_dir).select("id", "latitude", "longitude"), "points")
    city = spatial.planar_nearest_km(points, src.cities(spark, sf_dir).withColumnRenamed("city_id", "other_id"))
    road = spatial.planar_nearest_km(points, highways(spark, sf_dir))
    both = points.select("id").join(city.select("id", F.col("km").alias("dist_city_km")), "id", "left")
    both = both.join(road.select("id", F.col("km").alias("dist_highway_km")), "id", "left")
    return rounded(both, "dist_city_km", "dist_highway_km")


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity of each place, the first by id; a fourth of them were there twice."""
    rows = src.entities(spark, sf_dir).select("id", "village_name", "latitude", "longitude")
    again = rows.filter("id % 4 = 0").withColumn("id", F.col("id") + 1_000_000)
    kept = files.first_by(rows.unionByName(again), ["latitude", "longitude"], [F.col("id").asc()])
    return kept.select("id", "village_name")


def settlement_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity of each chain of places 30 km apart: a named one before others, then the one with most tags."""
    rows = _named(spark, sf_dir).join(src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("tags")), "id")
    named = F.length(F.coalesce("village_name", F.lit(""))) > 0
    order = [named.desc(), F.col("tags").desc(), F.col("id").asc()]
    return scoring.keep_best_linked(rows, *spatial.metre_links(rows, 30_000.0), order).select("id", "village_name")


def _tiles(spark: SparkSession) -> DataFrame:
    cells = raster.grid_cells(7.5, 68.0, 37.5, 97.5, 3.0)
    rows = [(w, s, e, n) for w, s, e, n in cells]
    return spark.createDataFrame(rows, "west double, south double, east double, north double")


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of three degrees over the extent, with the entities in each."""
    at = [F.floor((F.col("latitude") - 7.5) / 3).alias("r"), F.floor((F.col("longitude") - 68.0) / 3).alias("c")]
    counts = src.entities(spark, sf_dir).groupBy(*at).agg(F.count(F.lit(1)).alias("entities"))
    own = _tiles(spark).withColumns({"r": F.round((F.col("south") - 7.5) / 3).cast("long"), "c": F.round((F.col("west") - 68.0) / 3).cast("long")})
    return own.join(counts, ["r", "c"], "left").select("west", "south", "east", "north", F.coalesce("entities", F.lit(0).cast("long")).alias("entities"))


def tile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the 3-degree tiles whose bounds, widened by a tenth, hold them."""
    tiles = _tiles(spark).withColumn("south", F.floor(F.col("south") / 3) * 3.0).withColumn("west", F.floor(F.col("west") / 3) * 3.0)
    tiles = tiles.select("south", "west", raster.tile_name(F.col("south") + 0.5, F.col("west") + 0.5).alias("tile")).distinct()
    return raster.in_tiles(src.entities(spark, sf_dir).select("id", "latitude", "longitude"), tiles, 3.0, 0.1).select("id", "tile")


def tile_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles' results as one table, an entity once: with the first of its tiles."""
    return files.first_by(tile_points(spark, sf_dir), ["id"], [F.col("tile").asc()])


def zonal_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and class share of the cells inside each polygon."""
    cells = src.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 59).alias("row"), (F.col("o_custkey") % 61).alias("col"), "o_orderkey")
    band = cells.groupBy("row", "col").agg((F.min("o_orderkey") % 100).cast("double").alias("value"))
    zones = polygons(spark).withColumnRenamed("name", "id")
    return rounded(raster.zonal_polygons(zones, band, 68.0, 37.5, 0.5, 99.0, 50.0), "mean", "share")


# Ranks, labels, serving


def base_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by descending score, ties averaged and cut to whole numbers."""
    rows = scored(spark, sf_dir).select("id", F.round("composite_score", 1).alias("score"))
    return validation.base_rank(rows, "score").select("id", "base_rank")


def ml_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two of the first four signals exceed their own ninth decile."""
    from upland.operators import ml

    rows = cut(grown(spark, sf_dir).filter(scoring.is_main()), "main-track")
    return ml.with_label(rows, ["ntl_growth_log", "builtup_change", "ghsl_change", "ntl_2024", "ntl_2019"]).select("id", "label")


def score_whole_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score clipped at nothing, as the amplifier's probabilities get."""
    from upland.functions import ranks

    rows = cut(grown(spark, sf_dir).select("id", "ntl_growth_log"), "signals")
    return rounded(ranks.with_minmax_scores(rows, {"ntl_growth_log": "score"}, 0.0, 1.0).select("id", "score"), "score")


def archetype_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that all bear one name say nothing, so the rules name the entities."""
    from upland.operators import ml
    from upland.plans.features import archetype_rules

    rules = archetype_rules(spark, sf_dir).withColumnRenamed("archetype_name", "rule_name")
    named = rules.withColumn("archetype_name", F.lit("Steady Grower"))
    return ml.guarded_names(named, "archetype_name", "rule_name").select("id", "archetype_name")


def api_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.ranked_whole(scored(spark, sf_dir))
    page = serving.page_with_total(rows, offset=5, limit=20, district="PROMO", min_score=10.0)
    return rounded(page.select("rank", "id", "composite_score", "total"), "composite_score")


def api_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.health(scoring.ranked(shortlist(spark, sf_dir)))


def api_forecast_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entity with its forecasts."""
    row = serving.by_id(src.panel(spark, sf_dir), "7", ensemble(spark, sf_dir))
    return rounded(row.select("id", "village_name", "state_name", "ntl_2024", *[f"ntl_forecast_{y}" for y in (2025, 2026, 2027)]), "ntl_2024")


def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each check of the panel's contract finds."""
    return validation.contract(src.panel(spark, sf_dir), 100, {"ntl_2019": 0.5, "ghsl_2015": 0.99}, {"ntl_2019": 5000.0, "ntl_2024": 0.001})


# Runs in parts


def incremental_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel from files that come in three parts, the last of which corrects the first."""
    schema = StructType.fromDDL("id long, year int, value double")
    source, sink, mark = (new_folder(spark, x) for x in ("incoming", "panel", "marks"))
    rows = cut(src.dense_panel(spark, sf_dir).select("id", "year", "value"), "dense")
    wrong = rows.filter("year <= 2020").withColumn("value", F.col("value") + 1)
    for part in (wrong, rows.filter("year > 2020"), rows.filter("year <= 2020")):
        part.write.mode("append").parquet(source)
        incremental.merge_panel(spark, source, schema, sink, mark)
    incremental.compact(spark, sink)
    return rounded(incremental.merged_panel(spark, sink, schema), *src.NTL)


def late_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities before and after a background job has written its table."""
    path, schema = new_folder(spark, "towers"), StructType.fromDDL("id long, towers long")
    rows = src.entities(spark, sf_dir).select("id")
    before = cut(incremental.with_late(rows, path, schema).withColumn("phase", F.lit("before")), "before")
    counted = spatial.radius_count(src.entities(spark, sf_dir), src.towers(spark, sf_dir), 1.5, "towers")
    counted.select("id", "towers").write.parquet(path)
    return before.unionByName(incremental.with_late(rows, path, schema).withColumn("phase", F.lit("after")))


QUERIES = {f.__name__: f for f in (
    csv_round_trip, csv_sample_coverage, json_round_trip, wkb_round_trip, gpkg_layer_scan, json_elements, json_towers, json_vertices,
    json_envelopes, literal_access, binary_grid, raster_tile_round_trip, content_types, catalogue_search, season_windows, bbox_filter,
    named_flags, signal_deltas, index_trends, population_merge, groundtruth_two_keys, groundtruth_fallback, polygon_fill_blank,
    city_and_highway, exact_duplicates, settlement_dedup, grid_cells, tile_points, tile_union, zonal_polygons, base_rank, ml_label,
    score_whole_range, archetype_guard, api_page_total, api_health, api_forecast_by_id, contract_report, incremental_panel, late_merge,
)}

_PLACE = "8.0::DOUBLE + ({k} * {a} % 29500) / 1000.0 AS {lat}, 68.0::DOUBLE + ({k} * {b} % 29500) / 1000.0 AS {lon}"
_ENTITY_ROWS = "id::VARCHAR AS id, village_name, state_name, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude"
_KEY = "replace(replace(lower(trim({})), ' ', ''), '-', '')"
_NAMED = """named AS (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'Village_' || id::VARCHAR WHEN id % 11 <> 0 THEN village_name END AS village_name)
  FROM entity)"""
_ROAD = f"road AS (SELECT s_suppkey AS other_id, {_PLACE.format(k='s_suppkey', a=6007, b=15013, lat='latitude', lon='longitude')} FROM supplier WHERE s_suppkey % 5 = 0)"
_MIN_KM = """(SELECT min(sqrt(pow(a.latitude - b.latitude, 2) + pow((a.longitude - b.longitude) * c, 2))) * 111.0 FROM {} b)"""
_TILE = "'N' || lpad((r * 3)::INT::VARCHAR, 2, '0') || 'E' || lpad((c * 3)::INT::VARCHAR, 3, '0')"
_TILE_POINTS = f"""spots AS (SELECT id, unnest(range(floor((latitude - 0.1) / 3)::BIGINT, floor((latitude + 0.1) / 3)::BIGINT + 1)) AS r, longitude FROM entity),
  tiled AS (SELECT id, r, unnest(range(floor((longitude - 0.1) / 3)::BIGINT, floor((longitude + 0.1) / 3)::BIGINT + 1)) AS c FROM spots),
  tile_points AS (SELECT id, {_TILE} AS tile FROM tiled WHERE r BETWEEN 2 AND 11 AND c BETWEEN 22 AND 31)"""


def _groundtruth_sql(ctes: str, join: str) -> str:
    """The classes of `groundtruth_classify` over another access figure."""
    whole = FEATURE_SQL["groundtruth_classify"]
    classes = whole[whole.index("SELECT id, round(access") :]
    return f"WITH {o.GROWN}, {ctes}, j AS (SELECT g.id, access, ntl_growth_pct AS g FROM grown g LEFT JOIN {join}) {classes}"


def _zone_sql() -> str:
    from upland.plans.spatial_queries import _inside

    parts = [f"SELECT '{n}' AS id, value FROM spots WHERE {_inside(r)}" for n, r in POLYGONS.items()]
    names = ", ".join(f"('{n}')" for n in POLYGONS)
    return f"""WITH band AS (SELECT o_orderkey % 59 AS row, o_custkey % 61 AS col, (min(o_orderkey) % 100)::DOUBLE AS value FROM orders GROUP BY 1, 2),
      spots AS (SELECT 68.0::DOUBLE + (col + 0.5::DOUBLE) * 0.5::DOUBLE AS longitude, 37.5::DOUBLE - (row + 0.5::DOUBLE) * 0.5::DOUBLE AS latitude, value FROM band WHERE value <> 99),
      hit AS ({' UNION ALL '.join(parts)}), z(id) AS (VALUES {names})
      SELECT z.id, round(avg(value), 6) AS mean, round(avg((value = 50)::INT), 6) AS share FROM z LEFT JOIN hit ON z.id = hit.id GROUP BY z.id"""


ORACLE_SQL = {
    "csv_round_trip": f"WITH {o.ENTITY} SELECT {_ENTITY_ROWS} FROM entity",
    "csv_sample_coverage": f"WITH {o.PANEL}, s AS (SELECT * FROM panel ORDER BY id LIMIT 5000) " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg(({c} IS NOT NULL)::INT), 6) AS share FROM s" for c in ("ntl_2019", "built_2020", "ghsl_2015")
    ),
    "json_round_trip": f"WITH {o.ENTITY} SELECT {_ENTITY_ROWS} FROM entity",
    "wkb_round_trip": f"WITH {o.ENTITY} SELECT id, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM entity",
    "gpkg_layer_scan": f"WITH {o.ENTITY} SELECT id, village_name, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM entity",
    "json_elements": f"""WITH {o.ENTITY}, t AS (SELECT id, latitude, longitude, CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 5 = 0 THEN '' ELSE village_name END END AS a,
      CASE WHEN id % 2 = 0 THEN village_name || '-local' END AS b, CASE WHEN id % 4 <> 0 THEN state_name END AS c FROM entity)
      SELECT id, coalesce(nullif(a, ''), b, '') AS name, coalesce(c, '') AS state, round(latitude, 6) AS lat, round(longitude, 6) AS lon,
      (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n_tags FROM t""",
    "json_towers": f"""WITH {o.TOWERS} SELECT tower_id AS id, round(latitude, 6) AS lat, round(longitude, 6) AS lon,
      CASE WHEN tower_id % 3 <> 0 THEN 'kind' || (tower_id % 4)::VARCHAR ELSE 'unknown' END AS tower_type FROM towers""",
    "json_vertices": f"""WITH {o.TOWERS}, p AS (SELECT n_regionkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS k, latitude, longitude
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN towers ON tower_id = s_suppkey) SELECT id, k, round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM p WHERE k % 5 = 0""",
    "json_envelopes": "SELECT n_nationkey AS k, n_name AS name FROM nation",
    "literal_access": "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', {v}::DOUBLE)" for i, (k, v) in enumerate(ACCESS_2011.items())) + f""") t(place, state_name, access)),
      c AS (SELECT c_custkey % {len(ACCESS_2011)} AS place, count(*) AS n FROM customer GROUP BY 1) SELECT state_name, access, coalesce(n, 0) AS customers FROM s LEFT JOIN c ON s.place = c.place""",
    "binary_grid": """WITH t AS (SELECT k.range AS k, a.range AS cell FROM range(4) k CROSS JOIN range(1200) a), v AS (SELECT l_suppkey % 4 AS k, l_partkey % 1200 AS cell, min(l_quantity)::DOUBLE / 4 AS value FROM lineitem GROUP BY 1, 2)
      SELECT 'tile' || t.k::VARCHAR AS path, (t.cell // 40)::INT AS row, (t.cell % 40)::INT AS col, round(68 + 4 * t.k + (t.cell % 40) * 0.1::DOUBLE, 6) AS longitude,
      round(37.5 - 3 * t.k - (t.cell // 40) * 0.1::DOUBLE, 6) AS latitude, value FROM t LEFT JOIN v ON t.k = v.k AND t.cell = v.cell WHERE t.k IN (SELECT k FROM v)""",
    "raster_tile_round_trip": "SELECT o_orderkey % 300 AS row, o_custkey % 200 AS col, min(o_orderkey)::DOUBLE AS value FROM orders GROUP BY 1, 2",
    "content_types": """WITH t AS (SELECT p_partkey AS id, p_name || '.' || ['csv', 'json', 'html', 'tif', 'bin'][p_partkey % 5 + 1] AS path FROM part)
      SELECT id, path, ['text/csv', 'application/json', 'text/html', 'image/tiff', 'application/octet-stream'][id % 5 + 1] AS content_type FROM t""",
    "catalogue_search": f"""WITH s AS (SELECT 'scene-' || o_custkey::VARCHAR AS id, o_orderkey AS key, o_orderstatus AS collection, o_orderdate::DATE AS day, (o_orderkey * 37 % 100)::DOUBLE AS cloud,
      {_PLACE.format(k='o_orderkey', a=5003, b=13007, lat='latitude', lon='longitude')} FROM orders),
      f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day, key) AS rn FROM s WHERE collection = 'O' AND cloud < 25 AND latitude BETWEEN 10 AND 30 AND longitude BETWEEN 70 AND 95
        AND (strftime(day, '%m-%d') BETWEEN '01-01' AND '05-31' OR strftime(day, '%m-%d') BETWEEN '10-01' AND '12-31'))
      SELECT id, key, collection, day::VARCHAR AS day, cloud FROM f WHERE rn = 1""",
    "season_windows": """SELECT 'Q' || quarter(l_shipdate)::VARCHAR AS season, count(*) AS n,
      count_if(strftime(l_shipdate, '%m-%d') >= '11-15' OR strftime(l_shipdate, '%m-%d') <= '02-10') AS winter FROM lineitem GROUP BY 1""",
    "bbox_filter": f"WITH {o.ENTITY} SELECT id FROM entity WHERE latitude BETWEEN 10 AND 30 AND longitude BETWEEN 70.5 AND 90.25",
    "named_flags": f"WITH {o.ENTITY}, {_NAMED} SELECT id, village_name, coalesce(regexp_matches(village_name, '^Village_\\d+$'), true) AS unnamed FROM named",
    "signal_deltas": f"WITH {o.INDICES} SELECT id, round(ndbi_2024 - ndbi_2019, 9) AS ndbi_growth, round(ndvi_2024 - ndvi_2019, 9) AS ndvi_growth, NULL::DOUBLE AS s1_vv_delta FROM indices",
    "index_trends": f"WITH {o.INDICES} SELECT id, round({o.slope('ndbi_')}, 9) AS ndbi_trend_slope, round({o.slope('ndvi_')}, 9) AS ndvi_trend_slope FROM indices",
    "population_merge": f"""WITH {o.ENTITY}, {o.POPULATION}, {o.INDICES} SELECT e.id, village_name, pop_2019, pop_2020, round(pop_growth_rate, 9) AS pop_growth_rate,
      round(ndbi_2019, 9) AS ndbi_2019, round(ndvi_2024, 9) AS ndvi_2024 FROM entity e LEFT JOIN population p ON e.id = p.id LEFT JOIN indices i ON e.id = i.id""",
    "groundtruth_two_keys": _groundtruth_sql(
        f"acc AS (SELECT {_KEY.format('state_name')} AS sk, {_KEY.format('district_name')} AS dk, avg(id * 37 % 1000 / 10.0::DOUBLE) AS access FROM entity WHERE id % 3 <> 1 GROUP BY 1, 2)",
        f"acc ON sk = {_KEY.format('g.state_name')} AND dk = {_KEY.format('g.district_name')}",
    ),
    "groundtruth_fallback": _groundtruth_sql(
        "acc AS (SELECT DISTINCT state_name AS s, substring(state_name, 7, 1)::DOUBLE * 15 AS access FROM entity)", "acc ON s = g.state_name"
    ),
    "polygon_fill_blank": f"""WITH {o.ENTITY}, pip AS ({'{pip}'}), f AS (SELECT id, min(name) AS name FROM pip GROUP BY id)
      SELECT e.id, CASE WHEN e.id % 4 IN (0, 1) THEN f.name ELSE state_name END AS state_name FROM entity e LEFT JOIN f ON e.id = f.id""",
    "city_and_highway": f"""WITH {o.ENTITY}, {o.CITIES}, {_ROAD}, m AS (SELECT cos(radians(avg(latitude))) AS c FROM entity), a AS (SELECT id, latitude, longitude, c FROM entity CROSS JOIN m)
      SELECT id, round({_MIN_KM.format('cities')}, 6) AS dist_city_km, round({_MIN_KM.format('road')}, 6) AS dist_highway_km FROM a""",
    "exact_duplicates": f"WITH {o.ENTITY} SELECT min(id) AS id, min_by(village_name, id) AS village_name FROM entity GROUP BY latitude, longitude",
    "settlement_dedup": "",
    "grid_cells": f"""WITH {o.ENTITY}, g AS (SELECT r.range AS r, c.range AS c, 68.0::DOUBLE + 3 * c.range AS west, 7.5::DOUBLE + 3 * r.range AS south, least(71.0::DOUBLE + 3 * c.range, 97.5) AS east, 10.5::DOUBLE + 3 * r.range AS north
      FROM range(10) r CROSS JOIN range(10) c), n AS (SELECT floor((latitude - 7.5) / 3)::BIGINT AS r, floor((longitude - 68.0) / 3)::BIGINT AS c, count(*) AS n FROM entity GROUP BY 1, 2)
      SELECT west, south, east, north, coalesce(n, 0) AS entities FROM g LEFT JOIN n ON g.r = n.r AND g.c = n.c""",
    "tile_points": f"WITH {o.ENTITY}, {_TILE_POINTS} SELECT id, tile FROM tile_points",
    "tile_union": f"WITH {o.ENTITY}, {_TILE_POINTS} SELECT id, min(tile) AS tile FROM tile_points GROUP BY id",
    "zonal_polygons": _zone_sql(),
    "base_rank": f"""WITH {o.SCORED}, s AS (SELECT id, round(composite_score, 1) AS v FROM scored)
      SELECT id, floor(rank() OVER (ORDER BY v DESC) + (count(*) OVER (PARTITION BY v) - 1) / 2.0)::BIGINT AS base_rank FROM s""",
    "ml_label": f"""WITH {o.GROWN}, m AS (SELECT * FROM grown WHERE is_main), q AS (SELECT """ + ", ".join(
        f"quantile_cont({c}, 0.9) AS q{k}" for k, c in enumerate(("ntl_growth_log", "builtup_change", "ghsl_change", "ntl_2024"))
    ) + """ FROM m) SELECT id, (""" + " + ".join(
        f"coalesce(({c} > q{k})::INT, 0)" for k, c in enumerate(("ntl_growth_log", "builtup_change", "ghsl_change", "ntl_2024"))
    ) + """ >= 2)::INT::DOUBLE AS label FROM m CROSS JOIN q""",
    "score_whole_range": f"""WITH {o.GROWN}, e AS (SELECT min(ntl_growth_log) AS lo, max(ntl_growth_log) AS hi FROM grown)
      SELECT id, round(coalesce((ntl_growth_log - lo) / (hi - lo) * 100.0, 0), 6) AS score FROM grown CROSS JOIN e""",
    "archetype_guard": FEATURE_SQL["archetype_rules"],
    "api_page_total": f"""WITH {o.SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY {o.ORDER}) AS rank FROM scored), f AS (SELECT *, count(*) OVER () AS total FROM r WHERE contains(lower(district_name), 'promo') AND composite_score >= 10)
      SELECT rank, id, round(composite_score, 6) AS composite_score, total FROM f ORDER BY f.rank LIMIT 20 OFFSET 5""",
    "api_health": f"""WITH {o.SCORED}, {o.TOP}, r AS (SELECT *, row_number() OVER (ORDER BY {o.ORDER}) AS rank FROM top)
      SELECT 'ok' AS status, count(*) AS entities, min_by(village_name, rank) AS top_village, min_by(state_name, rank) AS top_state FROM r""",
    "api_forecast_by_id": FEATURE_SQL["ensemble"].replace("WITH ", f"WITH {o.PANEL}, ", 1).replace(" SELECT id, round(coalesce(", ", fc AS (SELECT id, round(coalesce(", 1)
    + ") SELECT p.id, village_name, state_name, round(p.ntl_2024, 6) AS ntl_2024, ntl_forecast_2025, ntl_forecast_2026, ntl_forecast_2027 FROM panel p LEFT JOIN fc ON p.id = fc.id WHERE p.id = 7",
    "contract_report": f"""WITH {o.PANEL} SELECT 'rows' AS check_name, count(*)::DOUBLE AS found, 100.0::DOUBLE AS bound, count(*) >= 100 AS passed FROM panel
      UNION ALL SELECT 'share of ntl_2019', round(avg((ntl_2019 IS NOT NULL)::INT), 6), 0.5, avg((ntl_2019 IS NOT NULL)::INT) >= 0.5 FROM panel
      UNION ALL SELECT 'share of ghsl_2015', round(avg((ghsl_2015 IS NOT NULL)::INT), 6), 0.99, avg((ghsl_2015 IS NOT NULL)::INT) >= 0.99 FROM panel
      UNION ALL SELECT 'most of ntl_2019', round(max(ntl_2019), 6), 5000, max(ntl_2019) <= 5000 FROM panel
      UNION ALL SELECT 'most of ntl_2024', round(max(ntl_2024), 6), 0.001, max(ntl_2024) <= 0.001 FROM panel""",
    "incremental_panel": f"WITH {o.DENSE} SELECT id, " + ", ".join(f"round(ntl_{y}, 6) AS ntl_{y}" for y in o.YEARS) + " FROM dense",
    "late_merge": f"""WITH {o.ENTITY}, {o.TOWERS}, n AS (SELECT a.id, count(b.tower_id) AS towers FROM entity a LEFT JOIN towers b ON {o.D2} <= 2.25 GROUP BY a.id)
      SELECT id, towers, 'after' AS phase FROM n UNION ALL SELECT id, NULL, 'before' FROM entity""",
}


def _finish() -> None:
    from upland.plans.spatial_queries import _CC, _PIP

    ORACLE_SQL["polygon_fill_blank"] = ORACLE_SQL["polygon_fill_blank"].replace("{pip}", _PIP)
    ORACLE_SQL["settlement_dedup"] = f"""WITH RECURSIVE {o.ENTITY}, {_NAMED}, e AS (SELECT n.*, p_size AS tags, longitude * cos(radians(20)) AS x FROM named n JOIN part ON id = p_partkey),
      pairs AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.id < b.id WHERE pow(a.latitude - b.latitude, 2) + pow(a.x - b.x, 2) <= pow(30000 / 111000.0::DOUBLE, 2)), {_CC},
      r AS (SELECT e.id, row_number() OVER (PARTITION BY component ORDER BY (coalesce(village_name, '') <> '')::INT DESC, tags DESC, e.id) AS place FROM e JOIN comp c ON e.id = c.id)
      SELECT id, village_name FROM e WHERE id NOT IN (SELECT id FROM r WHERE place > 1)"""


_finish()
