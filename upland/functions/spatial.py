"""Distances and point-in-polygon tests, as expressions. The metric is always named by the function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def degrees2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared distance in raw degrees."""
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def crossings(x: Column, y: Column, edges: Column) -> Column:
    """How many of the edges (x1, y1, x2, y2) a ray from the point to the right crosses."""
    return F.size(F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray from the point crosses an odd number of edges."""
    return crossings(x, y, edges) % 2 == 1
