"""Checks of a scored table: correlation, stability, autocorrelation, representation, confounds, AUC, contracts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from upland.functions import ranks
from upland.operators import balanced, shuffles, spatial
from upland.operators.topk import first_in_groups
from upland.sources.store import cut


#: Rows of a shuffle that one task orders, about.
RANGE_ROWS = 1_000_000
#: Values of a batch of shuffles, and the least draws of one; values that a task hashes, and that a block or part holds.
AT_ONCE, LEAST_DRAWS, TASK_VALUES, VALUES = 1 << 25, 32, 1 << 20, 1 << 21


def spearman(df: DataFrame, signals: list[str], least: int = 50) -> DataFrame:
    """a, b, rho of every two signals, both ways round, over the rows that have the first two signals and both; null
    below `least` rows; a signal with itself is 1.

    The pairs are rows of one long table, so all are ranked and correlated in one run of joins."""
    rows = df.select(*signals).na.drop(subset=signals[:2])
    pairs = [F.struct(F.lit(k).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for k, (a, b) in enumerate(combinations(signals, 2))]
    long = cut(rows.select(F.inline(F.array(*pairs))).filter("x is not null and y is not null"), "pairs")
    ranked = long
    for c in ("x", "y"):
        placed = ranks.positions_within(long.select("pair", F.col(c).alias("value")), ["pair"])
        middle = placed.select("pair", F.col("value").alias(c), (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"rank_{c}"))
        ranked = ranked.join(middle, ["pair", c])
    rho = F.when(F.count(F.lit(1)) >= least, F.round(F.corr("rank_x", "rank_y"), 3))
    found = ranked.groupBy("pair").agg(rho.alias("rho"))
    names = [(k, a, b) for k, (a, b) in enumerate(combinations(signals, 2))]
    spark = df.sparkSession
    both = spark.createDataFrame([*names, *[(k, b, a) for k, a, b in names]], "pair int, a string, b string").join(found, "pair", "left")
    own = spark.createDataFrame([(s, s, 1.0) for s in signals], "a string, b string, rho double")
    return both.select("a", "b", "rho").unionByName(own)


def representation(df: DataFrame, top: DataFrame, group: str = "state_name") -> DataFrame:
    """Each group's share of all rows and of the top, and their ratio."""
    count = lambda d, name: d.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias(name))
    rows = count(df, "all_count").join(count(top, "top_count"), group, "outer").na.fill(0, ["all_count", "top_count"])
    sums = rows.agg(F.sum("all_count").alias("all_total"), F.sum("top_count").alias("top_total"))
    rows = rows.crossJoin(F.broadcast(sums))  # one row
    share, top_share = F.col("all_count") / F.col("all_total") * 100, F.col("top_count") / F.col("top_total") * 100
    return rows.select(group, share.alias("all_pct"), "top_count", top_share.alias("top_pct"), F.round(top_share / F.when(share == 0, 0.001).otherwise(share), 2).alias("over_rep_ratio"))


def confound(top: DataFrame) -> DataFrame:
    """Counts of three flags, of their conjunction, and its percentage."""
    early, total = F.coalesce(F.col("ntl_2021") - F.col("ntl_2019"), F.lit(0.0)), F.coalesce(F.col("ntl_2024") - F.col("ntl_2019"), F.lit(0.0))
    low = F.coalesce(F.col("ntl_2019"), F.lit(0.0)) < 0.5
    front = (total > 0) & (early / F.nullif(total, F.lit(0.0)) > 0.7)
    flat = F.abs(F.coalesce(F.col("builtup_change"), F.lit(0.0))) < 0.01
    return top.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(low).alias("low_baseline_count"), F.count_if(front).alias("growth_frontloaded_count"), F.count_if(flat).alias("flat_builtup_count"),
        F.count_if(low & front & flat).alias("electrification_only_risk_count"), F.round(F.count_if(low & front & flat) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 1).alias("electrification_only_risk_pct"),
    )


def moran(points: DataFrame, value: str, k: int = 8) -> DataFrame:
    """i, n and k: spatial autocorrelation under row-normalised weights of the k nearest."""
    x = cut(points.filter(F.col(value).isNotNull()).select("id", "latitude", "longitude", value), "moran")
    mean = x.agg(F.avg(value).alias("mean"))
    dev = x.crossJoin(F.broadcast(mean)).select("id", "latitude", "longitude", (F.col(value) - F.col("mean")).alias("x"))  # one row
    dev = cut(dev, "deviations")
    lag = spatial.spatial_lag(dev, "x", k)
    return dev.hint("merge").join(lag, "id").agg((F.sum(F.col("x") * F.col("spatial_lag")) / F.sum(F.col("x") * F.col("x"))).alias("i"), F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))


def _first_places(dev: DataFrame, seed: int) -> DataFrame:
    """id and its place, from 0, in the order of the hash of draw 0; hashes are uniform, so their leading digits deal
    points into ranges of about RANGE_ROWS rows, and no task orders more than a range."""
    digits = max(0, math.ceil(math.log(max(1, dev.count() / RANGE_ROWS), 16)))
    mark = F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit("0"), F.lit(str(seed))))
    rows = dev.select("id", mark.alias("mark")).withColumn("range", F.substring("mark", 1, digits))
    totals = rows.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    inside = rows.withColumn("inside", F.row_number().over(Window.partitionBy("range").orderBy("mark", "id")))
    offsets = totals.select("range", F.coalesce(before, F.lit(0)).alias("offset"))
    return inside.hint("merge").join(offsets, "range").select("id", (F.col("inside") + F.col("offset") - 1).alias("place"))


@contextmanager
def _shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Files of a query's shuffles go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def moran_permutations(points: DataFrame, value: str, k: int = 8, draws: int = 999, seed: int = 42) -> DataFrame:
    """Share of value shuffles whose statistic reaches the observed one.

    A shuffle gives each point the deviation of the point with the same place in the order of a hash of id and draw; draw
    0 so gives each its own. Draws go in batches of about AT_ONCE values, or LEAST_DRAWS, whose shuffled files are gone
    before the next, so disk holds some draws of all points, never all. Within a batch all moves in packed arrays
    (`shuffles`): ranges of about RANGE_ROWS hashes are ordered, blocks of places deal their values to parts of the plane,
    leaves of the balanced partition that lie together, and a part adds up all draws at once over its neighbours, which
    are found once."""
    spark = points.sparkSession
    x = cut(points.filter(F.col(value).isNotNull()).select("id", "latitude", "longitude", value), "moran")
    mean = x.agg(F.avg(value).alias("mean"))
    dev = cut(x.crossJoin(F.broadcast(mean)).select("id", "latitude", "longitude", (F.col(value) - F.col("mean")).alias("x")), "deviations")  # one row
    n = dev.count()
    at_once = min(draws + 1, max(LEAST_DRAWS, AT_ONCE // max(1, n)))
    width = max(balanced.LEAF, VALUES // at_once)  # places of a block, points of a part

    places = cut(_first_places(dev, seed), "places")
    near = cut(spatial.nearest(dev, dev.select(F.col("id").alias("other_id"), "latitude", "longitude"), k, exclude_self=True).select("id", "other_id"), "neighbours")
    _, leaves = balanced.plane(dev.select("id", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]).na.drop(), ["id"], None)
    spread = leaves.select("leaf", F.posexplode("members").alias("pos", "member"))
    part = F.floor(F.col("leaf") / (width // balanced.LEAF)) * (1 << 32) + F.floor(F.col("pos") / width)  # a crowded leaf is many
    home = spread.select(part.cast("long").alias("part"), "member.id").hint("merge").join(places, "id")
    others = places.select(F.col("id").alias("other_id"), F.col("place").alias("other"))
    edges = near.hint("merge").join(home, "id").hint("merge").join(others, "other_id").select("part", "place", "other")
    edges = cut(edges, "edges-of-blocks")
    parts = cut(edges.groupBy("part").applyInArrow(shuffles.packed, shuffles.PARTS), "parts")
    asked = cut(parts.mapInArrow(shuffles.asks(width), shuffles.ASKS), "asks")

    ranges = max(1, math.ceil(n / RANGE_ROWS))
    found = []
    for first in range(0, draws + 1, at_once):
        batch = range(first, min(draws + 1, first + at_once))
        rows = dev.select(F.col("id").cast("string").alias("text"), "x").repartition(max(1, math.ceil(n * len(batch) / TASK_VALUES)))
        hashes = rows.mapInArrow(shuffles.hashed(batch, seed, ranges), shuffles.HASHES)
        pieces = hashes.groupBy("draw", "range").applyInArrow(shuffles.ordered(width), shuffles.PIECES)
        given = pieces.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(shuffles.dealt(batch, width), shuffles.DEALT)
        sums = given.groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(shuffles.products(batch), shuffles.SUMS)
        with _shuffles_cleared(spark):
            found.append(cut(sums.groupBy("draw").agg((F.sum("xl") / F.sum("xx")).alias("i")), "statistics"))
    stats = reduce(DataFrame.unionByName, found)  # a row a draw
    seen = stats.filter("draw = 0").select(F.col("i").alias("seen"))
    reached = F.avg((F.col("i") >= F.col("seen")).cast("double")).alias("p_value")
    return stats.filter("draw > 0").crossJoin(F.broadcast(seen)).agg(reached, F.first("seen").alias("i"))  # one row


def weight_draws(weights: list[float], draws: int, alpha: float = 10.0, seed: int = 42) -> list[list[float]]:
    """Dirichlet draws around the weights; a few hundred short rows, made on the driver."""
    base = np.array(weights) / sum(weights)
    rng = np.random.default_rng(seed)
    return [[round(float(x), 6) for x in rng.dirichlet(alpha * base)] for _ in range(draws)]


#: Further apart than this, two scores can't be equal to nine places; rows that a task weighs at once.
NINTH, WEIGHED = 2e-9, 1 << 16


def could_be_taken(scores: np.ndarray, group: np.ndarray, n: int, cap: int) -> np.ndarray:
    """Whether a row can be among the first n, of one draw of weights, of which at most `cap` are of its group.

    Rows that come before it in a part of a table come before it in the whole, so what isn't taken here never is: either
    `cap` rows of its group are before it, or n rows of which each group has `cap` at most."""
    order = np.lexsort((-scores, group))
    own = group[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    least = np.full(int(group.max()) + 1, -np.inf)
    last = order[place == cap - 1]
    least[group[last]] = scores[last]
    first = scores[order[place < cap]]
    bar = np.partition(first, len(first) - n)[len(first) - n] if len(first) > n else -np.inf
    return scores >= np.maximum(least[group], bar) - NINTH


def drawn_best(ranked: DataFrame, columns: list[str], group: str, draws: list[list[float]], n: int, cap: int) -> DataFrame:
    """draw, id, group and score `s` of rows that a draw could take: the union over all parts of the table, each of
    which keeps some n rows a draw. Rows never meet draws outside a task, whose matrix has WEIGHED rows or little more."""
    weights = np.array(draws)
    names = ["draw", "id", "group", "s"]

    def weigh(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        codes = table.column(1).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        values = [table.column(k + 2).to_numpy() for k in range(len(columns))]
        scores = np.zeros((len(weights), table.num_rows))
        for w, v in zip(weights.T, values, strict=True):  # in the order of the columns, as Spark adds them
            scores += w[:, None] * v[None, :]
        own = codes.indices.to_numpy().astype(np.int64)
        return scores, np.stack([could_be_taken(s, own, n, cap) for s in scores])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= WEIGHED:
                table = pa.Table.from_batches(held)
                held = table.filter(pa.array(weigh(table)[1].any(0))).to_batches()
                rows = 0
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            scores, taken = weigh(table)
            for draw in range(len(weights)):
                at = pa.array(np.flatnonzero(taken[draw]))
                own = table.take(at).combine_chunks()
                columns_out = [pa.array(np.full(len(at), draw, np.int32)), own.column(0).combine_chunks(), own.column(1).combine_chunks(), pa.array(scores[draw][taken[draw]])]
                yield pa.RecordBatch.from_arrays(columns_out, names=names)

    rows = ranked.select("id", F.col(group).alias("group"), *columns)
    schema = StructType([StructField("draw", IntegerType()), rows.schema["id"], rows.schema["group"], StructField("s", DoubleType())])
    return rows.mapInArrow(run, schema)


def stability(df: DataFrame, signals: list[str], draws: list[list[float]], top: DataFrame, cap: int, group: str = "state_name") -> DataFrame:
    """id and the percentage of weight draws whose capped best hold the row, for the rows of `top`, as many as which
    each draw takes.

    Signals enter as percent ranks, missing ones as the highest; weights aren't negative; a missing group is a group.
    Every task cuts its rows to those that a draw could take, so what is shuffled doesn't grow with rows times draws."""
    n = top.count()
    ranked = ranks.with_pct_ranks(df.select("id", group, *signals), {s: f"{s}_pct" for s in signals})
    near = drawn_best(ranked, [f"{s}_pct" for s in signals], group, draws, n, cap).withColumn("s", F.round("s", 9)) if n else ranked.select(F.lit(0).alias("draw"), "id", F.col(group).alias("group"), F.lit(0.0).alias("s"))
    order = [F.desc("s"), F.asc("id")]
    within = first_in_groups(near, ["draw", "group"], order, cap, "place").drop("place")
    counts = first_in_groups(within, ["draw"], order, n, "rank").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    share = F.round(F.coalesce("times", F.lit(0)) / len(draws) * 100, 1)
    return top.select("id").join(counts, "id", "left").select("id", share.alias("inclusion_pct"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve as the Mann-Whitney statistic of averaged ranks."""
    rows = ranks.with_pct_rank(df.select(score, label), score, "pct")
    n, positive = F.count(F.lit(1)).cast("double"), F.sum(F.col(label).cast("double"))
    above = F.sum(F.when(F.col(label) == 1, F.col("pct"))) / 100 * n - positive * (positive + 1) / 2
    return rows.agg((above / F.nullif(positive * (n - positive), F.lit(0.0))).alias("auc"))


def base_rank(df: DataFrame, score: str, out: str = "base_rank") -> DataFrame:
    """Rank by descending score, ties averaged, cut to whole numbers; null scores come last."""
    rows = ranks.with_pct_ranks(df.withColumn("negated_score", -F.col(score)), {"negated_score": "pct"})
    total = rows.agg(F.count(F.lit(1)).alias("rows_of_table"))
    rank = F.floor(F.round(F.col("pct") * F.col("rows_of_table") / 100.0, 3)).cast("long")
    return rows.crossJoin(F.broadcast(total)).withColumn(out, rank).drop("negated_score", "pct", "rows_of_table")  # one row


def _measures(coverage: dict[str, float], most: dict[str, float]) -> list[Column]:
    shares = [F.avg(F.col(c).isNotNull().cast("double")).alias(f"share of {c}") for c in coverage]
    return [F.count(F.lit(1)).cast("double").alias("rows"), *shares, *[F.max(c).cast("double").alias(f"most of {c}") for c in most]]


def cut_and_measured(df: DataFrame, name: str, coverage: dict[str, float], most: dict[str, float]) -> tuple[DataFrame, dict[str, float | None]]:
    """The table as written in the shared folder, and what its checks measure: observed while it is written, so they take
    no pass of their own."""
    seen = Observation(name)
    table = cut(df.observe(seen, *_measures(coverage, most)), name)
    return table, {k: seen.get[k] for k in ("rows", *[f"share of {c}" for c in coverage], *[f"most of {c}" for c in most])}


def contract(df: DataFrame, rows: int, coverage: dict[str, float], most: dict[str, float]) -> DataFrame:
    """check_name, found, bound and passed of each check, measured while the table is written."""
    _, found = cut_and_measured(df, "contract", coverage, most)
    bounds = {"rows": float(rows)} | {f"share of {c}": float(v) for c, v in coverage.items()} | {f"most of {c}": float(v) for c, v in most.items()}
    kept = lambda k, v, b: v is not None and (v <= b if k.startswith("most of") else v >= b)
    shown = {k: round(v, 6) if v is not None else None for k, v in found.items()}
    listed = [(k, shown[k], b, kept(k, shown[k], b)) for k, b in bounds.items()]
    return df.sparkSession.createDataFrame(listed, "check_name string, found double, bound double, passed boolean")


def checked(df: DataFrame, name: str, required: list[str], rows: int, coverage: dict[str, float], most: dict[str, float]) -> DataFrame:
    """The table, written; a ValueError that names all it lacks if it breaks its contract."""
    missing = [f"missing column {c}" for c in required if c not in df.columns]
    if missing:
        raise ValueError("; ".join(missing))
    table, found = cut_and_measured(df, name, coverage, most)
    lacks = _lacks(found, rows, coverage, most)
    if lacks:
        raise ValueError("; ".join(lacks))
    return table


def _lacks(found: dict[str, float | None], rows: int, coverage: dict[str, float], most: dict[str, float]) -> list[str]:
    out = [f"{int(found['rows'])} rows, {rows} needed"] if found["rows"] < rows else []
    out += [f"{c}: {found[f'share of {c}']} present, {v} needed" for c, v in coverage.items() if (found[f"share of {c}"] or 0) < v]
    return out + [f"{c}: {found[f'most of {c}']} above {v}" for c, v in most.items() if found[f"most of {c}"] is not None and found[f"most of {c}"] > v]


def check_contract(df: DataFrame, required: list[str], rows: int, coverage: dict[str, float], most: dict[str, float]) -> list[str]:
    """What a table that isn't to be written lacks: columns, rows, shares of non-null values, upper bounds; one aggregate
    over it. `checked` measures a table while it is written."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        return [f"missing column {c}" for c in missing]
    return _lacks(df.agg(*_measures(coverage, most)).first().asDict(), rows, coverage, most)
