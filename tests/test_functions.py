"""Ranks, scores, series and spatial expressions against hand-made and brute-force values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from upland.functions import ranks, series
from upland.functions import spatial as sp
from upland.operators import scoring, spatial, validation
from upland.operators.components import components
from upland.sources.panel import NTL


def test_pct_rank_ties_and_nulls(spark):
    rows = [(i, v) for i, v in enumerate([5.0, 1.0, None, 5.0, 2.0, None])]
    out = {r.id: r.p for r in ranks.with_pct_rank(spark.createDataFrame(rows, "id int, v double"), "v", "p").collect()}
    assert out == pytest.approx({0: 350 / 6, 1: 100 / 6, 2: 550 / 6, 3: 350 / 6, 4: 200 / 6, 5: 550 / 6})


def test_quantiles_by_positions_equal_one_aggregate(spark):
    random.seed(1)
    df = spark.createDataFrame([(random.choice([None, random.randint(0, 30) / 7.0]),) for _ in range(500)], "v double").cache()
    shares = [0.0, 0.02, 0.33, 0.5, 0.99, 1.0]
    assert ranks.by_positions(df, "v", shares) == pytest.approx(ranks.quantiles(df, {"v": shares})["v"])
    assert ranks.quantiles(df.filter("false"), {"v": [0.5]}) == {"v": [None]}
    assert ranks.by_positions(df.filter("v is null"), "v", [0.5]) == [None]


def test_minmax_degenerate_columns(spark):
    df = spark.createDataFrame([(1, 3.0, None, 1.0), (2, 3.0, None, None), (3, 3.0, None, 9.0)], "id int, flat double, none double, v double")
    out = {r.id: (r.a, r.b, r.c) for r in ranks.with_minmax_scores(df, {"flat": "a", "none": "b", "v": "c"}).collect()}
    assert out[1][0] == pytest.approx(200 / 3) and out[1][1] == 0.0
    assert out[2][2] == 0.0 and out[3][2] == pytest.approx(100.0) and out[1][2] == pytest.approx(0.0)


def test_zscore_of_small_groups_keeps_units(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 4.0), ("b", None)], "k string, v double")
    out = ranks.with_zscore(df, "v", "k", "z").collect()
    assert {(r.k, r.v): r.z for r in out} == {("a", 1.0): -1.0, ("a", 3.0): 1.0, (None, 4.0): 0.0, ("b", None): 0.0}


def test_trend_and_changepoint_against_numpy(spark):
    random.seed(2)
    rows = [(i, *[None if random.random() < 0.25 else random.uniform(0, 9) for _ in NTL]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in NTL))
    out = df.select("id", series.trend()[0].alias("s"), series.changepoint().alias("c"), series.damped_holt().alias("h")).collect()
    x = np.arange(2019, 2025)
    for r in out:
        y = np.array([np.nan if v is None else v for v in rows[r.id][1:]])
        ok = ~np.isnan(y)
        assert (r.s is None) == (ok.sum() < 3)
        if r.s is not None:
            assert r.s == pytest.approx(np.polyfit(x[ok], y[ok], 1)[0], abs=1e-9)
        assert (r.c is not None) == any(ok[:k].sum() >= 2 and ok[k:].sum() >= 2 for k in range(2, 5))
        assert (r.h is None) == (ok.sum() < 3) and (r.h is None or len(r.h) == 3 and min(r.h) >= 0)


def test_changepoint_of_a_clear_break(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 5.0, 10.0, 15.0)], ", ".join(f"{c} double" for c in NTL))
    c = df.select(series.changepoint().alias("c")).first().c
    assert (c.year, c.pre, c.post) == (2021, 0.0, 5.0) or (c.year, c.pre) == (2022, 0.0)


def test_nearest_matches_brute_force(spark):
    random.seed(3)
    pts = [(i, random.uniform(8, 37), random.uniform(68, 97)) for i in range(80)]
    pts += [(100 + i, 8.0 + i * 1e-4, 68.0) for i in range(15)]  # a dense corner beside sparse space
    df = spark.createDataFrame(pts, "id int, latitude double, longitude double")
    got = spatial.nearest(df, df.select(F.col("id").alias("other_id"), "latitude", "longitude"), 3, exclude_self=True)
    found = {}
    for r in got.collect():
        found.setdefault(r.id, []).append((r.rn, r.other_id))
    for i, a, b in pts:
        want = sorted(((a - c) ** 2 + (b - d) ** 2, j) for j, c, d in pts if j != i)[:3]
        assert [j for _, j in sorted(found[i])] == [j for _, j in want]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}


def test_chained_duplicates_collapse_to_one(spark):
    rows = spark.createDataFrame([(1, "X", 10.0), (2, "X (OSM 42)", 30.0), (3, "x", 20.0), (4, "", 5.0)], "id int, village_name string, composite_score double")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert {r.id for r in scoring.keep_best(rows, pairs, scoring.order_of()).collect()} == {2, 4}
    assert [r.n for r in rows.select(scoring.base_name(F.col("village_name")).alias("n")).collect()] == ["x", "x", "x", ""]


def test_cap_counts_no_blank_group(spark):
    rows = [(i, g, float(100 - i)) for i, g in enumerate(["a"] * 5 + [None, ""] * 3 + ["b"] * 4)]
    top = scoring.capped(spark.createDataFrame(rows, "id int, state_name string, composite_score double"), 10, 0.2).collect()
    kept = [r.state_name for r in top]
    assert kept.count("a") == 2 and kept.count("b") == 2 and len(kept) == 10


def test_weights_and_votes():
    assert scoring.redistribute({"a": 0.3, "b": 0.1, "c": 0.6}, ["a", "b"]) == pytest.approx({"a": 0.75, "b": 0.25})
    assert scoring.redistribute({"a": 1.0}, []) == {}


def test_haversine(spark):
    d = spark.range(1).select(sp.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first().d
    assert d == pytest.approx(math.pi * 6371.0)


def test_contract(spark):
    df = spark.createDataFrame([(1, None), (2, 6.0)], "id int, v double")
    assert validation.check_contract(df, ["id", "w"], 1, {}, {}) == ["missing column w"]
    assert len(validation.check_contract(df, ["id"], 5, {"v": 0.9}, {"v": 5.0})) == 3
    assert validation.check_contract(df, ["id"], 1, {"v": 0.5}, {"v": 7.0}) == []


def test_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert validation.auc(df, "s", "y").first().auc == pytest.approx(0.75)
