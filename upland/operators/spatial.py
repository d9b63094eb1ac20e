"""Spatial joins by grid cells: every join is an equi-join on cells with the exact test behind it. Nearest neighbours and
counts within a radius go by the balanced partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.functions import spatial as sp
from upland.operators.balanced import nearest, radius_count
from upland.sources.store import cut

__all__ = [
    "fill_blank", "first_polygon", "in_polygons", "metre_links", "named_links", "named_pairs", "nearest", "planar_nearest_km", "radius_count", "radius_links",
    "spatial_lag", "within_radius",
]
#: Ids of one place that are packed together, about.
CHUNK = 256


def _cells(lat: Column, lon: Column, size_lat: float, size_lon: float) -> list[Column]:
    return [F.floor(lat / size_lat).cast("long").alias("cell_r"), F.floor(lon / size_lon).cast("long").alias("cell_c")]


def _ring(df: DataFrame) -> DataFrame:
    """Each row at its own cell and the eight around it."""
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    return df.withColumn("step", F.explode(steps)).withColumns({"cell_r": F.col("cell_r") + F.col("step.r"), "cell_c": F.col("cell_c") + F.col("step.c")}).drop("step")


def within_radius(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of a left and a right row at most `radius` degrees apart; left columns l_*, right columns r_*."""
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], *_cells(F.col("latitude"), F.col("longitude"), radius, radius))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], *_cells(F.col("latitude"), F.col("longitude"), radius, radius))
    near = sp.degrees2(F.col("l_latitude"), F.col("l_longitude"), F.col("r_latitude"), F.col("r_longitude")) <= radius * radius
    # the ring is nine times the table whose size Spark knows, so no side is broadcast by that
    return _ring(a).hint("merge").join(b, ["cell_r", "cell_c"]).filter(near).drop("cell_r", "cell_c")


def spatial_lag(points: DataFrame, value: str, k: int = 10) -> DataFrame:
    """id and the mean of the k nearest other points' values, a missing value counting as 0."""
    others = points.select(F.col("id").alias("other_id"), "latitude", "longitude")
    near = nearest(points, others, k, exclude_self=True)
    values = points.select(F.col("id").alias("other_id"), F.coalesce(F.col(value), F.lit(0.0)).alias("v"))
    return near.hint("merge").join(values, "other_id").groupBy("id").agg(F.avg("v").alias("spatial_lag"))


#: By how much an edge must clear a cell to be taken as beside it or through it, against the last bits of a crossing.
CLEAR = 1e-9


def cell_cover(polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """cell_r, cell_c, name, odd, turns and edges of the cells that each polygon meets; `polygons` has name and edges (x1, y1, x2, y2).

    Of a row of cells only the edges of its own band of latitudes count, clipped to the band. For one cell those on its
    left are never crossed by a ray to the right. One on its right is crossed from its lower end up to its upper end, so
    whether a ray at y crosses an odd number of them is whether an odd number of their ends lies at or below y: ends
    that two of them share cancel out, ends below the band are one bit, `odd`, and the few left are `turns`. A cell
    without edges and turns lies wholly inside, or outside and has no row; border cells keep the edges near them."""
    low, high = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    edges = polygons.select("name", F.explode("edges").alias("e")).select("name", *[F.col(f"e.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], low.alias("low"), high.alias("high"))
    rows = edges.withColumn("cell_r", F.explode(F.sequence(F.floor(F.col("low") / cell).cast("long"), F.floor(F.col("high") / cell).cast("long"))))
    south, north = F.col("cell_r") * cell, (F.col("cell_r") + 1) * cell
    at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * (F.greatest(F.least(y, F.col("high")), F.col("low")) - F.col("y1")) / (F.col("y2") - F.col("y1"))
    flat = F.col("low") == F.col("high")
    ends = [F.when(flat, F.col("x1")).otherwise(at(south)), F.when(flat, F.col("x2")).otherwise(at(north))]
    clipped = rows.select("name", "cell_r", F.least(*ends).alias("west"), F.greatest(*ends).alias("east"), F.struct("x1", "y1", "x2", "y2").alias("edge"))
    banded = clipped.groupBy("name", "cell_r").agg(F.min("west").alias("west"), F.max("east").alias("east"), F.collect_list(F.struct("west", "east", "edge")).alias("band"))
    dealt = banded.select("name", "cell_r", "band", F.explode(F.sequence(F.floor((F.col("west") - CLEAR) / cell).cast("long"), F.floor((F.col("east") + CLEAR) / cell).cast("long"))).alias("cell_c"))
    left, right = F.col("cell_c") * cell, (F.col("cell_c") + 1) * cell
    beyond = F.filter("band", lambda e: e["west"] >= right + CLEAR)
    ends = F.array_sort(F.concat(F.transform(beyond, lambda e: e["edge"]["y1"]), F.transform(beyond, lambda e: e["edge"]["y2"])))
    single = lambda held, y: F.when((F.size(held) > 0) & (F.try_element_at(held, F.lit(-1)) == y), F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(y)))
    near = F.transform(F.filter("band", lambda e: (e["west"] < right + CLEAR) & (e["east"] > left - CLEAR)), lambda e: e["edge"]).alias("edges")
    cells = dealt.select("cell_r", "cell_c", "name", F.aggregate(ends, F.array().cast("array<double>"), single).alias("ends"), near)
    odd = (F.size(F.filter("ends", lambda y: y <= south - CLEAR)) % 2).alias("odd")
    turns = F.filter("ends", lambda y: (y > south - CLEAR) & (y < north + CLEAR)).alias("turns")
    return cells.select("cell_r", "cell_c", "name", odd, turns, "edges").filter((F.col("odd") == 1) | (F.size("turns") > 0) | (F.size("edges") > 0))


def in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """id and name of each polygon that holds the point; `polygons` has name and edges (x1, y1, x2, y2).

    Points are joined with the polygons' cells; a point in a cell that lies wholly inside meets no edge."""
    at = points.select("id", "latitude", "longitude", *_cells(F.col("latitude"), F.col("longitude"), cell, cell))
    crossed = sp.crossings(F.col("longitude"), F.col("latitude"), F.col("edges"))
    turned = F.size(F.filter("turns", lambda y: y <= F.col("latitude")))
    return at.join(cell_cover(polygons, cell), ["cell_r", "cell_c"]).filter((F.col("odd") + turned + crossed) % 2 == 1).select("id", "name")


def fill_blank(points: DataFrame, polygons: DataFrame, column: str, is_blank: Column) -> DataFrame:
    """`column` of the blank rows from the first polygon that holds them; other rows meet no polygon and stay."""
    todo = points.filter(is_blank)
    held = in_polygons(todo, polygons).groupBy("id").agg(F.min("name").alias("name"))
    return points.join(held, "id", "left").withColumn(column, F.coalesce("name", F.when(~is_blank, F.col(column)))).drop("name")


def first_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Every point with the first polygon that holds it, by name, or null."""
    held = in_polygons(points, polygons).groupBy("id").agg(F.min("name").alias("name"))
    return points.join(held, "id", "left")


def metre_links(points: DataFrame, metres: float, latitude: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """`radius_links` of points at most `metres` apart on a plane true at one latitude."""
    flat = points.select("id", "latitude", (F.col("longitude") * math.cos(math.radians(latitude))).alias("longitude"))
    return radius_links(flat, metres / 111_000.0)


def planar_nearest_km(points: DataFrame, others: DataFrame) -> DataFrame:
    """id, other_id and km to the nearest other on a plane true at the points' mean latitude."""
    middle = points.agg(F.avg("latitude")).first()[0] or 0.0
    shrink = lambda df: df.withColumn("longitude", F.col("longitude") * F.lit(math.cos(math.radians(middle))))
    return nearest(shrink(points), shrink(others), 1).select("id", "other_id", (F.sqrt("d2") * 111.0).alias("km"))


def _chunks(rows: DataFrame, place: list[str]) -> DataFrame:
    """The columns `place`, which rows share, with the ids of at most about CHUNK of them and the least of these, `head`."""
    many = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = rows.hint("merge").join(many, place).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks"))
    packed = dealt.groupBy(*place, "chunk").agg(F.collect_list("id").alias("ids"), F.min("id").alias("head"))
    return cut(packed.drop("chunk"), "places")


def _lattice(places: DataFrame, radius_km: float) -> tuple[DataFrame, DataFrame]:
    """`places` at each cell around them and at their own. Bands of latitude are as high as the radius; each is parted into
    cells as wide as two places at most the radius apart, one of them in the band, can lie from one another."""
    step = radius_km / 111.0
    band = F.floor(F.col("latitude") / step)
    reach = math.sin(min(radius_km / sp.EARTH_KM / 2, math.pi / 2))
    shrunk = F.cos(F.radians(F.least((F.abs(F.col("band") + 0.5) + 1.5) * step, F.lit(90.0))))
    wide = F.degrees(F.asin(F.least(F.lit(reach) / F.greatest(shrunk, F.lit(1e-9)), F.lit(1.0)))) * 2 + 1e-6
    cells = F.greatest(F.floor(F.lit(360.0) / wide), F.lit(1)).cast("long")
    column = F.least(F.floor(F.pmod("longitude", F.lit(360.0)) / (F.lit(360.0) / F.col("cells"))).cast("long"), F.col("cells") - 1)
    own = places.withColumn("band", band).withColumn("cells", cells).withColumn("cell", column).drop("cells")
    around = places.withColumn("band", F.explode(F.array(*[band + k for k in (-1, 0, 1)]))).withColumn("cells", cells).withColumn("cell", column)
    near = F.array_distinct(F.array(*[F.pmod(F.col("cell") + k, F.col("cells")) for k in (-1, 0, 1)]))
    return around.withColumn("cell", F.explode(near)).drop("cells"), own


def _near(places: DataFrame, radius_km: float, *own: str) -> DataFrame:
    """Pairs of two of the named places at most `radius_km` apart, each with itself too, by ascending `head`: base, km, and
    a_ and b_ of the columns `own`."""
    around, at = _lattice(places, radius_km)
    keys, kept = ["base", "band", "cell"], ["latitude", "longitude", "head", *[c for c in own if c != "head"]]
    a, b = (df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in kept]) for df, side in ((around, "a"), (at, "b")))
    km = sp.haversine(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    # either side may be larger than the table it is made of
    return a.hint("merge").join(b, keys).filter("a_head <= b_head").withColumn("km", km).filter(F.col("km") <= radius_km)


def _named(points: DataFrame, name: Column) -> DataFrame:
    return points.select("id", "latitude", "longitude", name.alias("base")).filter("base <> '' and latitude is not null and longitude is not null")


def named_pairs(points: DataFrame, name: Column, radius_km: float) -> DataFrame:
    """a < b and km of points of one non-blank name at most `radius_km` apart on the sphere.

    Names alone may repeat without bound, so cells of the radius are part of the join key. Distances are those of places;
    the points of two places, in chunks, become pairs behind the join, so nothing that grows with the pairs is
    shuffled."""
    near = _near(_chunks(_named(points, name), ["base", "latitude", "longitude"]), radius_km, "ids")
    each = near.select("km", (F.col("a_head") == F.col("b_head")).alias("same"), F.explode("a_ids").alias("x"), "b_ids").select("km", "same", "x", F.explode("b_ids").alias("y"))
    return each.filter("not same or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "km")


def named_links(points: DataFrame, name: Column, radius_km: float) -> tuple[DataFrame, DataFrame]:
    """What `named_pairs` joins, without its pairs of points: id and its place's first id, `head`, for each point; a and b
    of heads at most `radius_km` apart."""
    place = ["base", "latitude", "longitude"]
    rows = _named(points, name)
    places = cut(rows.groupBy(*place).agg(F.min("id").alias("head")), "places")
    links = _near(places, radius_km).filter("a_head < b_head").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    return rows.hint("merge").join(places, place).select("id", "head"), links


def radius_links(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """`named_links` of points at most `radius` degrees apart, whatever their names."""
    rows = points.select("id", "latitude", "longitude").filter("not isnan(latitude) and not isnan(longitude)")
    places = cut(rows.groupBy("latitude", "longitude").agg(F.min("id").alias("id")), "places")
    links = within_radius(places, places, radius).filter("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    heads = places.select("latitude", "longitude", F.col("id").alias("head"))
    return rows.hint("merge").join(heads, ["latitude", "longitude"]).select("id", "head"), links
