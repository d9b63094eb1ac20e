"""Search of a scene catalogue: collections in order of preference, bounding box, date windows, cloud cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.sources.files import first_by


def in_window(day: Column, first: str, last: str) -> Column:
    """Whether a day of any year lies between two (month, day) marks, both included; a window may pass the year's end."""
    mark = F.date_format(day, "MM-dd")
    return (mark >= first) & (mark <= last) if first <= last else (mark >= first) | (mark <= last)


def season(day: Column) -> Column:
    """Quarter of the year's growing cycle: the one of a day, as Q1 to Q4."""
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


def search(
    catalogue: DataFrame,
    collections: list[str],
    box: tuple[float, float, float, float],
    windows: list[tuple[str, str]],
    most_cloud: float,
) -> DataFrame:
    """Scenes of the first collection that has any: inside the box (south, west, north, east), in one of the windows
    and with less than `most_cloud` cloud; of scenes with one id the first by date, then by key."""
    south, west, north, east = box
    inside = F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    timely = F.lit(False)
    for first, last in windows:
        timely |= in_window(F.col("day"), first, last)
    rows = catalogue.filter(inside & timely & (F.col("cloud") < most_cloud))
    for name in collections:
        found = rows.filter(F.col("collection") == name)
        if not found.isEmpty():
            return first_by(found, ["id"], [F.col("day").asc(), F.col("key").asc()])
    return rows.filter("false")
