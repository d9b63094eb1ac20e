"""Caps, group ranks and weight draws against plain versions, and the shapes of their plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from upland.functions import ranks
from upland.operators import scoring, topk, validation


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(n=600, seed=5):
    """A state with most of the rows, small ones, blank names and equal scores."""
    rng = random.Random(seed)
    states = ["A"] * 8 + ["B", "C", None, "", " nan", "None"]
    return [(i, rng.choice(states), rng.choice([rng.random(), 0.5, None]), rng.choice(["d1", "d2", None])) for i in range(n)]


SCHEMA = "id long, state_name string, composite_score double, district string"


def test_cap_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    plan = plan_of(scoring.capped(df, 100, 0.4))
    assert "Partial" in plan[plan.rindex("WindowGroupLimit") :] and plan.count("WindowGroupLimit") >= 2
    below = plan[plan.rindex("WindowGroupLimit") :]
    assert "Exchange" not in below.split("Scan")[0]  # the partial limit stands below the exchange by state


def test_cap_against_a_plain_walk(spark):
    rows = rows_of()
    blank = lambda s: s is None or s.strip() in ("", "nan", "None")
    for n, share in ((100, 0.4), (30, 0.1), (1000, 0.01)):
        cap, taken, want = max(1, int(n * share)), {}, []
        for i, state, _, _ in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0])):
            if len(want) < n and (blank(state) or taken.get(state, 0) < cap):
                taken[state] = taken.get(state, 0) + 1
                want.append(i)
        assert [r.id for r in scoring.capped(spark.createDataFrame(rows, SCHEMA), n, share).collect()] == want


def test_first_in_groups_beyond_the_limit(spark):
    df = spark.range(0, 9000, numPartitions=6).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.lit(None)).alias("k"), (F.col("id") % 50).alias("v"))
    got = topk.first_in_groups(df, ["k"], [F.desc("v"), F.asc("id")], 1500, "place", slices=7)
    want = {k: sorted((r.id for r in df.collect() if r.k == k), key=lambda i: (-(i % 50), i))[:1500] for k in ("hot", None)}
    found = {}
    for r in got.collect():
        found.setdefault(r.k, {})[r.place] = r.id
    assert {k: [x[p] for p in sorted(x)] for k, x in found.items()} == want and sorted(found["hot"]) == list(range(1, 1501))


def test_percent_ranks_within_groups(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGES", 8)
    rows = rows_of(400)
    got = {r.id: r.p for r in ranks.with_pct_rank_within(spark.createDataFrame(rows, SCHEMA), F.col("composite_score"), ["state_name", "district"], "p").collect()}
    for i, state, v, district in rows:
        own = [r[2] for r in rows if r[1] == state and r[3] == district]
        if state is None or district is None:
            assert got[i] is None
        else:
            below = sum(x is not None and x < v for x in own) if v is not None else sum(x is not None for x in own)
            assert got[i] == pytest.approx((below + (sum(x == v for x in own) + 1) / 2) / len(own) * 100)


def test_groups_are_no_tasks(spark):
    """Group means and ranks come from partial aggregates or ranges of values, never from a window over a whole group."""
    df = spark.createDataFrame(rows_of(), SCHEMA)
    plan = plan_of(ranks.with_zscore(df, "composite_score", "state_name", "z"))
    assert "Window" not in plan and "partial_avg" in plan
    assert "windowspecdefinition(district#" not in plan_of(ranks.with_pct_rank_within(df, F.col("composite_score"), ["district"], "p")).split("range")[0]


def plain_draws(pct, draws, n, cap):
    times = {}
    for w in draws:
        s = {i: round(sum(np.float64(a) * b for a, b in zip(p, w, strict=True)), 9) for i, (_, p) in pct.items()}
        taken, kept = {}, 0
        for i in sorted(s, key=lambda i: (-s[i], i)):
            g = pct[i][0]
            if kept < n and taken.get(g, 0) < cap:
                taken[g] = taken.get(g, 0) + 1
                kept += 1
                times[i] = times.get(i, 0) + 1
    return times


@pytest.mark.parametrize(("n", "cap", "weighed"), [(40, 12, 1 << 16), (40, 12, 30), (7, 1, 50), (500, 3, 64)])
def test_stability_against_a_plain_walk(spark, monkeypatch, n, cap, weighed):
    monkeypatch.setattr(validation, "WEIGHED", weighed)
    rng = random.Random(1)
    rows = [(i, rng.choice(["A"] * 6 + ["B", "C", None]), float(rng.randrange(40)), float(rng.randrange(12)), rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, state_name string, a double, b double, c double").repartition(4)
    draws = validation.weight_draws([0.5, 0.3, 0.2], 25)
    ranked = ranks.with_pct_ranks(df, {s: f"{s}_pct" for s in "abc"})
    pct = {r.id: (r.state_name, (r.a_pct, r.b_pct, r.c_pct)) for r in ranked.collect()}
    want = plain_draws(pct, draws, n, cap)
    top = df.orderBy("id").limit(n).select("id")
    got = {r.id: r.inclusion_pct for r in validation.stability(df, ["a", "b", "c"], draws, top, cap).collect()}
    assert got == {i: round(want.get(i, 0) / 25 * 100, 1) for i in range(n)}
    near = validation.drawn_best(ranked, ["a_pct", "b_pct", "c_pct"], "state_name", draws, n, cap)
    parts = ranked.rdd.getNumPartitions()
    assert near.count() <= 25 * parts * (n + 60)  # with near ties, never rows times draws


def test_permutations_in_many_blocks(spark, monkeypatch):
    """Blocks of neighbours, and ranges of a shuffle's order, give what one matrix gives."""
    import hashlib

    rng = random.Random(9)
    rows = [(i, rng.choice([20.0, 20 + rng.random(), rng.uniform(8, 37)]), 70 + rng.random() * 3, rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, latitude double, longitude double, v double")
    plane, small = validation.balanced.plane, validation.balanced.plane
    monkeypatch.setattr(validation.balanced, "plane", lambda places, own, count, leaf=16: small(places, own, count, 16))
    monkeypatch.setattr(validation, "RANGE_ROWS", 100)
    got = validation.moran_permutations(df, "v", 4, draws=12).first()
    x = np.array([r[3] for r in rows])
    x = x - x.mean()
    at = np.array([r[1:3] for r in rows])
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    near = np.lexsort((np.broadcast_to(np.arange(300), d2.shape), d2))[:, :4]
    stat = lambda y: (y * y[near].mean(1)).sum() / (y * y).sum()
    order = lambda d: sorted(range(300), key=lambda i: (hashlib.md5(f"{i}-{d}-42".encode()).hexdigest(), i))
    drawn = []
    for d in range(1, 13):
        y = np.empty(300)
        y[order(0)] = x[order(d)]
        drawn.append(stat(y))
    assert plane is small and got.i == pytest.approx(stat(x)) and got.p_value == pytest.approx(np.mean(np.array(drawn) >= stat(x)))


def test_bounds_of_ranges_are_found_once(spark, monkeypatch):
    """Approximate quantiles depend on the order of their parts; here they differ whenever they are computed."""
    drawn = F.udf(lambda top: sorted(random.SystemRandom().uniform(0, top) for _ in range(7)), "array<double>").asNondeterministic()
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda value, *_: drawn(F.max(value)))
    monkeypatch.setattr(ranks, "RANGES", 8)
    rows = [(k, k % 3, float(k * 37 % 500)) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, g int, composite_score double")
    spark.conf.set("spark.sql.exchange.reuse", "false")  # no result may rest on it
    try:
        within = ranks.with_pct_rank_within(df, F.col("composite_score"), ["g"], "p").collect()
        numbers = ranks.with_row_numbers(df, "composite_score", "id", "p").collect()
        placed = ranks.positions(df, "composite_score").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for r in within:
        own = [v for _, g, v in rows if g == r.g]
        assert r.p == pytest.approx((sum(v < r.composite_score for v in own) + (own.count(r.composite_score) + 1) / 2) / len(own) * 100)
    assert [r.id for r in sorted(numbers, key=lambda r: r.p)] == [r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))]
    assert {r.value: r.before for r in placed} == {v: sum(w < v for _, _, w in rows) for _, _, v in rows}
