"""The first rows of each group in an order, without a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slices that a group is dealt into before its first rows are known.
SLICES = 64


def first_in_groups(df: DataFrame, keys: list[str], order: list[Column], most: int, place: str, slices: int = SLICES) -> DataFrame:
    """The first `most` rows of each group, numbered from 1 in `place`; a null key is a group too.

    The filter is a plain rank, so up to spark.sql.optimizer.windowGroupLimitThreshold rows a group Spark limits each
    group within the tasks before it shuffles. Beyond that, where it doesn't, each group is dealt into `slices` by a
    hash of the rows first, and at most `most * slices` rows of a group meet in one task. Rows that tie in `order` are
    taken as they come; make the order total for results that repeat."""
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    near = df
    if most > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        dealt = df.withColumn("slice_of_row", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(slices)))
        inside = F.row_number().over(Window.partitionBy(*keys, "slice_of_row").orderBy(*order))
        near = dealt.withColumn(place, inside).filter(F.col(place) <= most).drop("slice_of_row", place)
    return near.withColumn(place, ranked).filter(F.col(place) <= most)
