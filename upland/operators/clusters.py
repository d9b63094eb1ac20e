"""K-means of many numbers of clusters and many starts at once, and the silhouette of a labelling.

All sets of centres go through the table together: a pass is one job, whose tasks weigh their rows against every set
and send a sum for each centre. What the driver holds are centres and sums, some hundred short rows.

Centres are seeded by k-means||: one row for each start, then twice about two rows for each centre, drawn with the
chance of their share of the cost so far; those candidates, weighed by the rows nearest to them, are thinned to k on
the driver. A draw is a hash of the row's values and the start, so reruns agree. Then Lloyd steps follow until no
centre of any set moves by more than TOL, or for STEPS passes; sets that have settled take no further part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from upland.sources.store import cut

#: Lloyd steps, and how far a settled centre may move; candidates for each centre and seeding step, and those steps.
STEPS, TOL, OVER, SEEDINGS = 20, 1e-4, 2, 2
#: Rows that a task weighs at once.
ROWS = 1 << 14


class Start(NamedTuple):
    k: int
    seed: int


Centres = dict[Start, np.ndarray]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(x: np.ndarray, start: Start, turn: int) -> np.ndarray:
    """A number from 0 to 1 for each row, by its values, the start and the turn."""
    out = np.full(len(x), (start.k * 1_000_003 + start.seed) * 64 + turn, np.uint64)
    for column in (x + 0.0).T:
        out = _mixed(out ^ np.ascontiguousarray(column).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return (_mixed(out) >> np.uint64(11)).astype(float) / 2.0**53


def distances2(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(centres)))
    for a, c in zip(x.T, centres.T, strict=True):
        out += (a[:, None] - c[None, :]) ** 2
    return out


def _bands(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, width)
        for i in range(0, len(x), ROWS):
            yield x[i : i + ROWS]


SUMS = "start int, cluster int, n long, cost double, sums array<double>"


def _sums(rows: DataFrame, weigh: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]], width: int) -> list:
    """start, cluster, n, cost and sums of each that `weigh` yields for a band of rows: first per task, then in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for x in _bands(batches, width):
            for start, n, cost, sums in weigh(x):
                held = total.setdefault(start, [np.zeros_like(n), np.zeros_like(cost), np.zeros_like(sums)])
                for own, more in zip(held, (n, cost, sums), strict=True):
                    own += more
        for start, (n, cost, sums) in total.items():
            columns = [pa.array(np.full(len(n), start, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(cost), pa.array(list(sums), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SUMS.split(", ")])

    each = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    found = rows.select("x").mapInArrow(run, SUMS).groupBy("start", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*each).alias("sums"))
    return found.collect()  # a row for each centre


class Pass(NamedTuple):
    n: np.ndarray
    cost: np.ndarray
    sums: np.ndarray


def assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equals, and the squared distance to it."""
    d2 = distances2(x, centres)
    own = d2.argmin(1)
    return own, d2[np.arange(len(x)), own]


def one_pass(rows: DataFrame, centres: Centres) -> dict[Start, Pass]:
    """How many rows each centre has, their cost and the sums of their values, for all sets of centres at once."""
    starts = list(centres)
    width = centres[starts[0]].shape[1]
    sets = [centres[s] for s in starts]

    def weigh(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, c in enumerate(sets):
            own, d2 = assigned(x, c)
            yield i, np.bincount(own, minlength=len(c)), np.bincount(own, d2, len(c)), np.stack([np.bincount(own, v, len(c)) for v in x.T], 1)

    out = {s: Pass(np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros_like(c)) for s, c in centres.items()}
    for r in _sums(rows, weigh, width):
        own = out[starts[r["start"]]]
        own.n[r["cluster"]], own.cost[r["cluster"]], own.sums[r["cluster"]] = r["n"], r["cost"], r["sums"]
    return out


def moved(centres: np.ndarray, found: Pass) -> np.ndarray:
    """The means of the rows of each centre; a centre without rows stays."""
    return np.where(found.n[:, None] > 0, found.sums / np.maximum(found.n, 1)[:, None], centres)


def lloyd(rows: DataFrame, centres: Centres, steps: int = STEPS, tol: float = TOL) -> Centres:
    """All sets of centres after their Lloyd steps, one pass a step."""
    done, active = {}, dict(centres)
    for _ in range(steps):
        if not active:
            break
        found = one_pass(rows, active)
        further = {s: moved(c, found[s]) for s, c in active.items()}
        still = {s for s, c in further.items() if (((c - active[s]) ** 2).sum(1) > tol * tol).any()}
        done |= {s: c for s, c in further.items() if s not in still}
        active = {s: further[s] for s in still}
    return {s: (done | active)[s] for s in centres}


def _rows_of(rows: DataFrame, pick: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]], width: int) -> DataFrame:
    """start, mark and x of the rows that `pick` yields of a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _bands(batches, width):
            for start, mark, own in pick(x):
                columns = [pa.array(np.full(len(mark), start, np.int32)), pa.array(mark, pa.float64()), pa.array(list(own), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["start", "mark", "x"])

    return rows.select("x").mapInArrow(run, "start int, mark double, x array<double>")


def thinned(points: np.ndarray, weight: np.ndarray, start: Start) -> np.ndarray:
    """At most k of the candidates: k-means++ by their weights, then weighted means until they settle."""
    points, back = np.unique(points, axis=0, return_inverse=True)
    weight = np.bincount(back.ravel(), weight)
    rng, own = np.random.default_rng([start.k, start.seed]), []
    near = np.full(len(points), np.inf)
    for _ in range(min(start.k, len(points))):
        chance = weight * np.where(np.isinf(near), 1.0, near)
        if not chance.sum():
            break
        own.append(points[rng.choice(len(points), p=chance / chance.sum())])
        near = np.minimum(near, distances2(points, own[-1][None])[:, 0])
    centres = np.array(own)
    for _ in range(30):
        at, _ = assigned(points, centres)
        n = np.bincount(at, weight, len(centres))
        sums = np.stack([np.bincount(at, weight * v, len(centres)) for v in points.T], 1)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centres)
        if (new == centres).all():
            break
        centres = new
    return centres


def seeded(rows: DataFrame, starts: list[Start], width: int) -> Centres:
    """Centres for every start by k-means||; no rows give no centres."""

    def least(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, s in enumerate(starts):
            u = drawn(x, s, 0)
            at = u.argmin()[None]
            yield i, u[at], x[at]

    first = _rows_of(rows, least, width).groupBy("start").agg(F.min(F.struct("mark", "x")).alias("least")).collect()
    held = {starts[r["start"]]: np.array([r["least"]["x"]]) for r in first}
    for turn in range(1, SEEDINGS + 1):
        if held:
            cost = {s: p.cost.sum() for s, p in one_pass(rows, held).items()}
            sets = dict(held)

            def chosen(x: np.ndarray, turn: int = turn, cost: dict = cost, sets: dict = sets) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                for i, s in enumerate(starts):
                    share = OVER * s.k * assigned(x, sets[s])[1] / max(cost[s], 1e-300)
                    at = np.flatnonzero(drawn(x, s, turn) < share)
                    yield i, share[at], x[at]

            for r in _rows_of(rows, chosen, width).select("start", "x").distinct().collect():  # about OVER * k rows a start
                s = starts[r["start"]]
                held[s] = np.concatenate([held[s], [r["x"]]])
    weighed = one_pass(rows, held) if held else {}
    return {s: thinned(held[s], p.n.astype(float), s) for s, p in weighed.items()}


def best_of(rows: DataFrame, ks: tuple[int, ...], seeds: tuple[int, ...], width: int) -> dict[int, np.ndarray]:
    """For each k the centres of the start with the least cost; `rows` is a written table with an array x."""
    starts = [Start(k, seed) for k in ks for seed in seeds]
    centres = seeded(rows, starts, width)
    if not centres:
        return {}
    centres = lloyd(rows, centres)
    cost = {s: p.cost.sum() for s, p in one_pass(rows, centres).items()}
    return {k: centres[min((s for s in starts if s.k == k), key=lambda s: (cost[s], s.seed))] for k in ks}


def silhouettes(rows: DataFrame, label: Callable[[np.ndarray], Iterator[np.ndarray]], labels: list[int], width: int, used: int | None = None) -> list[float]:
    """The mean silhouette, by squared distances of the first `used` values, of several labellings at once; nan where
    fewer than two labels occur.

    Mean squared distances to a cluster follow from its size, its sum and its sum of squares, so two passes do. A row
    alone in its cluster has 0."""
    square = lambda x: (x * x).sum(1)
    blanked = lambda x: x if used is None else np.where(np.arange(width) < used, x, 0.0)

    def weigh(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, (own, k) in enumerate(zip(list(label(x)), labels, strict=True)):
            x = blanked(x)
            yield i, np.bincount(own, minlength=k), np.bincount(own, square(x), k), np.stack([np.bincount(own, v, k) for v in x.T], 1)

    stats = [Pass(np.zeros(k), np.zeros(k), np.zeros((k, width))) for k in labels]
    for r in _sums(rows, weigh, width):
        own = stats[r["start"]]
        own.n[r["cluster"]], own.cost[r["cluster"]], own.sums[r["cluster"]] = r["n"], r["cost"], r["sums"]

    def score(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, (own, s) in enumerate(zip(list(label(x)), stats, strict=True)):
            x = blanked(x)
            apart = square(x)[:, None] * s.n + s.cost - 2 * x @ s.sums.T  # summed squared distances to each cluster
            apart = np.maximum(apart, 0)
            at = np.arange(len(x))
            inner = apart[at, own] / np.maximum(s.n[own] - 1, 1)
            other = np.where(s.n > 0, apart / np.maximum(s.n, 1), np.inf)
            other[at, own] = np.inf
            outer = other.min(1)
            most = np.maximum(inner, outer)
            value = np.where((s.n[own] > 1) & (most > 0) & np.isfinite(most), (outer - inner) / np.where(most > 0, most, 1), 0.0)
            yield i, np.array([len(x)]), np.array([value.sum()]), np.zeros((1, width))

    out = [float("nan")] * len(labels)
    for r in _sums(rows, score, width):
        if (stats[r["start"]].n > 0).sum() > 1:
            out[r["start"]] = r["cost"] / r["n"]
    return out


def with_cluster(rows: DataFrame, centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """The rows with their nearest centre's number; the array x goes."""
    schema = StructType([*(f for f in rows.schema.fields if f.name != "x"), StructField(out, IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, centres.shape[1])
            own, _ = assigned(x, centres)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(own.astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def labelled_silhouette(rows: DataFrame, columns: list[str], label: Column, k: int) -> DataFrame:
    """One row: the silhouette of `rows` under a label from 0 to k - 1, and their number; rows with a null value or label
    take no part."""
    values = F.array(*[F.col(c).cast("double") for c in columns], label.cast("double"))
    table = cut(rows.select(values.alias("x")).filter(~F.exists("x", lambda v: v.isNull())), "labelled")
    found = silhouettes(table, lambda x: iter([x[:, -1].astype(np.int64)]), [k], len(columns) + 1, len(columns))
    return rows.sparkSession.createDataFrame([(found[0], table.count())], "silhouette double, n long")
