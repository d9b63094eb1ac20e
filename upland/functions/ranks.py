"""Exact ranks and quantiles of a column without sending all its rows to one task.

Distinct values are counted, dealt into ranges by approximate quantiles, and summed within each range; the
ranges' totals, at most RANGES rows, give the offsets. Both percent ranks and quantiles are read off the
resulting table of value, n and the rows before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from upland.sources.store import cut

RANGES = 64
#: Rows whose distinct values one task may hold.
SMALL = 1_000_000


def edges(df: DataFrame, value: Column, keys: list[str] | None = None) -> DataFrame:
    """`bounds` of RANGES ranges of the value, one row, or one for each group. They are written, as their aggregate depends
    on the order in which its parts come in: found once for the rows and once for the offsets, they might not agree."""
    bounds = F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 1000).alias("bounds")
    return cut(df.groupBy(*(keys or [])).agg(bounds), "bounds")


def positions(df: DataFrame, column: str) -> DataFrame:
    """value, n, before (rows with a smaller value) of the non-null values."""
    values = df.select(F.col(column).alias("value")).filter("value is not null")
    bounds = edges(values, F.col("value"))
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.crossJoin(F.broadcast(bounds)).withColumn("range", F.size(F.filter("bounds", lambda b: b <= F.col("value")))).drop("bounds")  # one row of bounds
    inside = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("n").alias("rows"))
    offsets = totals.select("range", F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.join(F.broadcast(offsets), "range").select("value", "n", (F.col("inside") + F.col("offset")).alias("before"))


def positions_within(values: DataFrame, keys: list[str]) -> DataFrame:
    """`positions` of the column `value` for each group, all groups at once: keys, value, n and before.

    A group's values are dealt into ranges of their own, so a group of any size is no single task."""
    bounds = edges(values, F.col("value"), keys)
    counted = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.join(bounds, keys).withColumn("range", F.size(F.filter("bounds", lambda b: b <= F.col("value")))).drop("bounds")
    inside = Window.partitionBy(*keys, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("rows").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy(*keys, "range").agg(F.sum("n").alias("rows"))
    offsets = totals.select(*keys, "range", F.coalesce(before, F.lit(0)).alias("offset"))  # RANGES rows a group
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.join(offsets, [*keys, "range"]).select(*keys, "value", "n", (F.col("inside") + F.col("offset")).alias("before"))


def with_pct_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Percent rank of each row for each column, under the name given, ties averaged; null ranks after all values
    and so has the highest percent. `df` is written first, as every column's statistics read it again.

    Several columns are ranked as one long table, so the number of joins doesn't grow with them."""
    base = cut(df.withColumn("row_of_rank", F.monotonically_increasing_id()), "ranked")
    sizes = base.agg(F.count(F.lit(1)).alias("all_rows"), *[F.count(c).alias(f"with_{k}") for k, c in enumerate(columns)]).first()
    middle = lambda: F.col("before") + (F.col("n") + 1) / 2.0
    rows = base
    if len(columns) > 2:
        values = F.array(*[F.struct(F.lit(k).alias("column"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)])
        long = base.select("row_of_rank", F.inline(values)).filter("value is not null")
        found = long.join(positions_within(long.select("column", "value"), ["column"]), ["column", "value"])
        wide = [F.max(F.when(F.col("column") == k, middle())).alias(out) for k, out in enumerate(columns.values())]
        rows = rows.join(found.groupBy("row_of_rank").agg(*wide), "row_of_rank", "left")
    else:
        for column, out in columns.items():
            ranked = positions(base, column).select(F.col("value").alias("ranked_value"), middle().alias(out))
            rows = rows.join(ranked, F.col(column) == F.col("ranked_value"), "left").drop("ranked_value")
    total = sizes["all_rows"]
    for k, out in enumerate(columns.values()):
        last = sizes[f"with_{k}"] + (total - sizes[f"with_{k}"] + 1) / 2.0
        rows = rows.withColumn(out, F.coalesce(F.col(out), F.lit(last)) / F.lit(max(total, 1)) * 100.0)
    return rows.drop("row_of_rank")


def with_pct_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    return with_pct_ranks(df, {column: out})


def with_row_numbers(df: DataFrame, score: str, key: str, out: str) -> DataFrame:
    """Dense row numbers by descending score, to nine places, and ascending key, without all rows in one task; null scores
    come last. `df` is read three times; write it first if dear."""
    value = F.round(score, 9)
    bounds = edges(df, value)
    above = F.when(value.isNull(), RANGES + 1).otherwise(F.size(F.filter(F.coalesce("bounds", F.array().cast("array<double>")), lambda b: b > value)))
    ranged = df.crossJoin(F.broadcast(bounds)).withColumn("range_of_row", above).drop("bounds")  # one row of bounds
    totals = ranged.groupBy("range_of_row").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("range_of_row").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("range_of_row", F.coalesce(before, F.lit(0)).alias("rows_before"))
    inside = F.row_number().over(Window.partitionBy("range_of_row").orderBy(value.desc_nulls_last(), F.col(key).asc()))
    placed = ranged.withColumn(out, inside).join(F.broadcast(offsets), "range_of_row")  # at most RANGES + 1 rows
    return placed.withColumn(out, (F.col(out) + F.col("rows_before")).cast("int")).drop("range_of_row", "rows_before")


def with_pct_rank_within(df: DataFrame, column: Column, keys: list[str], out: str) -> DataFrame:
    """`df` with the percent rank of `column` within each group, ties averaged, nulls after all values; a null key gives
    null. Groups are ranked in ranges of their values, so a group of any size is no single task. `df` is written first."""
    base = cut(df.withColumn("value_of_rank", column), "ranked-within")
    rows = base.select(*keys, F.col("value_of_rank").alias("value")).na.drop(subset=keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_group"), F.count("value").alias("known_of_group"))
    placed = positions_within(rows.filter("value is not null"), keys).withColumnRenamed("value", "value_of_rank")
    middle = F.coalesce(F.col("before") + (F.col("n") + 1) / 2.0, F.col("known_of_group") + (F.col("rows_of_group") - F.col("known_of_group") + 1) / 2.0)
    met = base.join(sizes, keys, "left").join(placed, [*keys, "value_of_rank"], "left")
    return met.withColumn(out, middle / F.col("rows_of_group") * 100.0).select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)


def quantiles(df: DataFrame, wanted: dict[str, list[float]], small: int = SMALL) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the columns; None where a column has no value.

    Up to `small` rows one aggregate finds all of them; beyond it, where the values of a column might not fit a
    task, they are read off its positions. Both are exact."""
    if df.limit(small + 1).count() <= small:
        row = df.agg(*[F.percentile(c, F.array(*map(F.lit, q))).alias(f"q{k}") for k, (c, q) in enumerate(wanted.items())]).first()
        return {c: list(row[f"q{k}"]) if row[f"q{k}"] is not None else [None] * len(q) for k, (c, q) in enumerate(wanted.items())}
    return {c: by_positions(df, c, q) for c, q in wanted.items()}


def by_positions(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    placed = cut(positions(df, column), "positions")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    at = lambda i: F.max(F.when((F.col("before") <= i) & (F.lit(i) < F.col("before") + F.col("n")), F.col("value")))
    row = placed.agg(*[at(math.floor(p)).alias(f"a{k}") for k, p in enumerate(places)], *[at(math.ceil(p)).alias(f"b{k}") for k, p in enumerate(places)]).first()
    return [float(row[f"a{k}"] + (row[f"b{k}"] - row[f"a{k}"]) * (p - math.floor(p))) for k, p in enumerate(places)]


def with_minmax_scores(df: DataFrame, columns: dict[str, str], low: float = 0.02, high: float = 0.99) -> DataFrame:
    """Quantile-clipped scores from 0 to 100, under the names given: null scores 0; where the quantiles coincide the
    percent rank stands in, and a column of nulls scores 0 throughout. `df` is read twice; write it first if dear."""
    bounds = quantiles(df, {c: [low, high] for c in columns})
    degenerate = {c: f"{out}_rank" for c, out in columns.items() if bounds[c][0] is not None and bounds[c][1] <= bounds[c][0]}
    rows = with_pct_ranks(df, degenerate) if degenerate else df
    for c, out in columns.items():
        lo, hi = bounds[c]
        if lo is None:
            score = F.lit(0.0)
        elif c in degenerate:
            score = F.when(F.col(c).isNull(), 0.0).otherwise(F.col(degenerate[c]))
        else:
            value = F.col(c)
            clipped = F.when(value < lo, F.lit(lo)).when(value > hi, F.lit(hi)).otherwise(value)
            score = F.coalesce((clipped - F.lit(lo)) / F.lit(hi - lo) * 100.0, F.lit(0.0))
        rows = rows.withColumn(out, score)
    return rows.drop(*degenerate.values())


def with_zscore(df: DataFrame, column: str, key: str, out: str, least: int = 3) -> DataFrame:
    """`df` with the distance from the group's mean in its standard deviations; groups of fewer than `least` rows keep
    their units; a null value or key gives 0. Groups are aggregated and joined back: a row a group. `df` is read
    twice; write it first if dear."""
    own = [F.avg(column).alias("mean_of_group"), F.stddev_samp(column).alias("spread_of_group"), F.count(column).alias("values_of_group")]
    stats = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_of_group")).agg(*own)
    scale = F.when(F.col("values_of_group") < least, 1.0).otherwise(F.greatest(F.coalesce("spread_of_group", F.lit(1.0)), F.lit(1e-6)))
    score = F.coalesce((F.col(column) - F.col("mean_of_group")) / scale, F.lit(0.0))
    return df.join(stats, F.col(key) == F.col("key_of_group"), "left").withColumn(out, score).drop("key_of_group", "mean_of_group", "spread_of_group", "values_of_group")
