"""Parameterised serving queries over a ranked table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["rank", "id", "village_name", "state_name", "district_name", "latitude", "longitude", "composite_score", "ntl_2019", "ntl_2024", "ntl_growth_pct", "archetype_name", "multi_signal_confirmed", "confidence_score"]


def present(df: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """The wanted columns that the table has."""
    return df.select([c for c in columns if c in df.columns])


def listing(df: DataFrame, *, state: str | None = None, district: str | None = None, archetype: str | None = None, confirmed: bool | None = None, min_score: float | None = None, max_rank: int | None = None, offset: int = 0, limit: int | None = 50) -> DataFrame:
    """A page of the rows that pass all filters, by rank; names match anywhere, whatever their case, never as patterns."""
    for column, text in (("state_name", state), ("district_name", district), ("archetype_name", archetype)):
        if text is not None:
            df = df.filter(F.coalesce(F.lower(column).contains(text.lower()), F.lit(False)))
    if confirmed is not None:
        df = df.filter(F.col("multi_signal_confirmed") == confirmed)
    if min_score is not None:
        df = df.filter(F.col("composite_score") >= min_score)
    if max_rank is not None:
        df = df.filter(F.col("rank") <= max_rank)
    return present(df if limit is None else df.orderBy("rank").offset(offset).limit(limit))


def page_with_total(df: DataFrame, offset: int = 0, limit: int = 50, **filters) -> DataFrame:
    """A page, each row with the number of rows that pass the filters."""
    whole = listing(df, offset=0, limit=None, **filters)
    total = whole.agg(F.count(F.lit(1)).alias("total"))
    return whole.orderBy("rank").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def health(shortlist: DataFrame) -> DataFrame:
    """One row: the service's state, and the size and head of the shortlist."""
    return shortlist.agg(
        F.lit("ok").alias("status"),
        F.count(F.lit(1)).alias("entities"),
        F.min_by("village_name", "rank").alias("top_village"),
        F.min_by("state_name", "rank").alias("top_state"),
    )


def by_id(df: DataFrame, key: str, forecasts: DataFrame | None = None) -> DataFrame:
    row = df.filter(F.col("id").cast("string") == str(key))
    return row if forecasts is None else row.join(forecasts, "id", "left")


def states(df: DataFrame) -> DataFrame:
    """Entities, mean score and the best entity of each state."""
    order = F.struct(-F.round("composite_score", 9), F.col("id"))
    best = F.min_by("village_name", order).alias("top_village")
    return df.groupBy("state_name").agg(F.count(F.lit(1)).alias("n"), F.avg("composite_score").alias("mean_score"), best)


def archetypes(df: DataFrame) -> DataFrame:
    """Entities and mean score of each archetype, the most common first."""
    out = df.groupBy("archetype_name").agg(F.count(F.lit(1)).alias("n"), F.avg("composite_score").alias("mean_score"))
    return out.orderBy(F.desc("n"), "archetype_name")


def figures(df: DataFrame) -> DataFrame:
    """Count, best score, median growth and number of states, as one row."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.max("composite_score").alias("best_score"), F.median("ntl_growth_pct").alias("median_growth"), F.countDistinct("state_name").alias("states"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin and n over equal widths between the column's least and greatest value."""
    ends = df.agg(F.min(column).alias("low_end"), F.max(column).alias("high_end"))
    width = F.nullif((F.col("high_end") - F.col("low_end")) / bins, F.lit(0.0))
    bin_of = F.least(F.coalesce(F.floor((F.col(column) - F.col("low_end")) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """column and the share of rows that have a value, in one aggregate."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "share")
