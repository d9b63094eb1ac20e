"""Operators whose results SQL can't give, or can't give for odd input, against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upland.functions import ranks, series
from upland.operators import ml, raster, scoring, validation
from upland.sources import catalogue, geometry, grids, store
from upland.streaming import incremental


def test_shapley_values_by_their_definition():
    rng = np.random.default_rng(3)
    forest = []
    for _ in range(20):
        path = {int(f): (float(lo), float(lo + 1), float(p)) for f, lo, p in zip(rng.choice(4, rng.integers(1, 4), replace=False), rng.normal(size=4), rng.uniform(0.1, 0.9, 4), strict=False)}
        forest.append((float(rng.normal()), path))
    x = rng.normal(size=(6, 4))

    def worth(row, known):
        out = 0.0
        for value, path in forest:
            for f, (low, high, share) in path.items():
                value *= (low < row[f] <= high) if f in known else share
            out += value
        return out

    got = ml.shapley(x, forest, 4)
    for r, row in enumerate(x):
        for f in range(4):
            others = [g for g in range(4) if g != f]
            want = sum(
                math.factorial(n) * math.factorial(3 - n) / 24 * (worth(row, {*s, f}) - worth(row, set(s)))
                for n in range(4)
                for s in itertools.combinations(others, n)
            )
            assert got[r, f] == pytest.approx(want)
        assert got[r].sum() == pytest.approx(worth(row, {0, 1, 2, 3}) - worth(row, set()))


def test_leaves_of_a_fitted_tree_add_up(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.normal(size=(300, 3)), columns=["a_full", "b_full", "c_full"])
    frame["label"] = ((frame.a_full > 0) & (frame.b_full > 0.2) | (frame.c_full > 1)).astype(float)
    model = ml.fit_amplifier(spark.createDataFrame(frame), ["a", "b", "c"], trees=3)
    scaled = model.transform(spark.createDataFrame(frame)).select("features").toPandas()["features"].map(lambda v: v.toArray())
    x = np.stack(scaled)
    for tree in model.stages[-1].trees:
        found = ml.leaves(tree)
        inside = np.array([[all(lo < row[f] <= hi for f, (lo, hi, _) in path.items()) for _, path in found] for row in x])
        assert (inside.sum(1) == 1).all()
        assert inside @ np.array([v for v, _ in found]) == pytest.approx([tree.predict(row_vector(r)) for r in x[:300]])


def row_vector(row):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(row)


def test_names_of_clusters():
    signals = ["ntl_growth_pct", "ndbi_growth", "ghsl_change", "dist_city_km", "dist_highway_km"]
    centres = [[5, 5, 5, 1, 9], [4, -3, 0, 9, 1], [-1, 4, 0, 9, 9], [-3, -3, -3, 9, 9], [-4, -4, -4, 9, 9]]
    assert ml.cluster_names(centres, [10, 10, 10, 60, 10], signals) == ["Urban Fringe Surge", "Industrial Corridor", "Agricultural Shift", "Steady Grower", "Active Growth"]
    assert ml.cluster_names(centres[:1], [5], signals) == ["Steady Grower"]
    assert len(set(ml.cluster_names([[0] * 5] * 4, [1, 1, 1, 1], signals))) == 4


def test_clusters_of_one_name_yield_to_rules(spark):
    df = spark.createDataFrame([(1, "x", "r1"), (2, "x", "r2")], "id int, name string, rule string")
    assert {r["name"] for r in ml.guarded_names(df, "name", "rule").collect()} == {"r1", "r2"}
    two = df.withColumn("name", F.col("id").cast("string"))
    assert {r["name"] for r in ml.guarded_names(two, "name", "rule").collect()} == {"1", "2"}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(k, float(k % 7)) for k in range(500)] + [(999, None), (998, None)]])
def test_row_numbers_by_ranges(spark, rows):
    df = spark.createDataFrame(rows, "id int, composite_score double")
    got = {r.id: r["rank"] for r in ranks.with_row_numbers(df, "composite_score", "id", "rank").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k for k, r in enumerate(order, 1)}


def test_positions_within_groups(spark):
    rows = [(k % 3, float(k * 7 % 50)) for k in range(900)]
    got = ranks.positions_within(spark.createDataFrame(rows, "g int, value double"), ["g"]).collect()
    for r in got:
        own = [v for g, v in rows if g == r.g]
        assert (r.n, r.before) == (own.count(r.value), sum(v < r.value for v in own))


def test_quantiles_agree_on_both_sides_of_the_switch(spark):
    rng = np.random.default_rng(5)
    values = [float(x) for x in rng.integers(0, 40, 2000)]  # ties at every range's edge
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.02, 0.25, 0.5, 0.99, 1.0]
    small, large = ranks.quantiles(df, {"v": shares}), ranks.quantiles(df, {"v": shares}, small=10)
    assert small["v"] == pytest.approx(large["v"]) and small["v"] == pytest.approx(list(np.quantile(values, shares)))


def test_gaps_and_damped_forecasts(spark):
    columns = [f"ntl_{y}" for y in range(2019, 2025)]
    rows = [(1.0, None, 3.0, None, None, 9.0), (None, 2.0, None, 4.0, None, None), (None,) * 6, (None, None, 5.0, None, None, None), tuple(map(float, range(6)))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, " + ", ".join(f"{c} double" for c in columns))
    got = {r.id: r for r in df.select("id", series.filled().alias("y"), series.damped_holt().alias("hw")).collect()}
    for k, row in enumerate(rows):
        there = [(i, v) for i, v in enumerate(row) if v is not None]
        if not there:
            assert got[k].y is None and got[k].hw is None
            continue
        y = np.interp(range(6), [i for i, _ in there], [v for _, v in there])
        assert got[k].y == pytest.approx(list(y))
        level, slope = y[0], y[1] - y[0]
        for v in y[1:]:
            before = level
            level = 0.5 * v + 0.5 * (level + 0.9 * slope)
            slope = 0.2 * (level - before) + 0.8 * 0.9 * slope
        assert got[k].hw == (None if len(there) < 3 else pytest.approx([max(0, level + 0.9**h * slope) for h in (1, 2, 3)]))


def test_base_rank_of_ties_and_nulls(spark):
    rows = [(k, v) for k, v in enumerate([5.0, 5.0, 7.0, 1.0, None, 5.0])]
    got = {r.id: r.base_rank for r in validation.base_rank(spark.createDataFrame(rows, "id int, s double"), "s").collect()}
    assert got == {2: 1, 0: 3, 1: 3, 5: 3, 3: 5, 4: 6}


def test_layers_columns_and_geometries(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]
    whole = geometry.package("land", pd.DataFrame({"name": ["a", None], "n": [1, 2], "more": ["x", "y"]}), [geometry.polygon_bytes([square]), geometry.point_bytes(1.0, 2.0)])
    other = geometry.package("roads", pd.DataFrame({"n": [1]}), [geometry.point_bytes(0.0, 0.0)])
    files = spark.createDataFrame([("a", whole), ("b", other)], "path string, content binary")
    got = sorted(geometry.read_layer(files, "land", {"n": "long", "name": "string", "absent": "string"}).collect(), key=lambda r: r.n)
    assert [(r.n, r.name, r.absent) for r in got] == [(1, "a", None), (2, None, None)]
    assert [(p.x, p.y) for p in got[0].rings[0]] == square and [(p.x, p.y) for p in got[1].rings[0]] == [(1.0, 2.0)]
    assert geometry.read_layer(files, "sea", {"n": "long"}).count() == 0
    assert geometry.rings_of(None) is None and geometry.rings_of(b"\x01\x02\x00\x00\x00") is None


def test_grid_metadata_is_needed():
    body = grids.grid_bytes(1.0, 2.0, 0.5, np.array([[1.0, np.nan]]), -9.0)
    assert grids.metadata(body)[0] == {"WestBound": 1e6, "NorthBound": 2e6, "CellSize": 5e5, "Rows": 1, "Columns": 2, "FillValue": -9}
    with pytest.raises(ValueError, match="WestBound"):
        grids.metadata(body.replace(b"West", b"Best"))


def test_catalogue_without_any_scene(spark):
    schema = "id string, key long, collection string, day date, cloud double, latitude double, longitude double"
    assert catalogue.search(spark.createDataFrame([], schema), ["a"], (0, 0, 1, 1), [("01-01", "12-31")], 25.0).count() == 0


def test_tiles_and_edge_cells(spark):
    cells = raster.grid_cells(7.5, 68.0, 37.5, 97.5, 3.0)
    assert len(cells) == 100 and cells[0] == (68.0, 7.5, 71.0, 10.5) and cells[9] == (95.0, 7.5, 97.5, 10.5)
    band = spark.createDataFrame([(0, 0, 1.0), (5, 70, 2.0)], "row long, col long, value double")
    assert sorted(map(tuple, raster.from_tiles(raster.to_tiles(band, 64), 64).collect())) == [(0, 0, 1.0), (5, 70, 2.0)]


def test_replayed_batches_are_taken_once(spark, tmp_path):
    schema = StructType.fromDDL("id long, year int, value double")
    source, sink, mark = (str(tmp_path / x) for x in ("in", "panel", "mark"))
    spark.createDataFrame([(1, 2019, 5.0), (1, 2020, 6.0)], schema).write.parquet(source)
    incremental.merge_panel(spark, source, schema, sink, mark)
    spark.createDataFrame([(1, 2020, 7.0)], schema).write.mode("append").parquet(source)
    incremental.merge_panel(spark, source, schema, sink, mark)
    for commit in (tmp_path / "mark" / "commits").glob("*1*"):  # as if the last batch had failed before its commit
        commit.unlink()
    incremental.merge_panel(spark, source, schema, sink, mark)
    row = incremental.merged_panel(spark, sink, schema).first()
    assert (row.ntl_2019, row.ntl_2020, row.ntl_2021) == (5.0, 7.0, None)
    assert incremental.panel_rows(spark, sink, schema).count() == 2  # what was taken is merged, once


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        applicationId, master = "app-of-test", "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        store.shared_root(Session())


def test_second_pass_of_duplicates(spark):
    rows = [(1, "Alpha", 10.0, 70.0, 9.0), (2, "alpha (OSM 5)", 10.01, 70.0, 8.0), (3, "Beta", 10.0, 70.0, 7.0), (4, "", 10.0, 70.0, 6.0), (5, "", 10.0, 70.0, 5.0)]
    from upland.plans import fullrun

    df = spark.createDataFrame(rows, "id long, village_name string, latitude double, longitude double, composite_score double")
    assert sorted(r.id for r in fullrun.one_of_a_name(df).collect()) == [1, 3, 4, 5]
    assert [r.id for r in df.withColumn("village_name", F.when(F.col("id") == 1, "Village_1").otherwise("x")).withColumn("composite_score", F.lit(5.0)).orderBy(*fullrun.preferred()).collect()][-1] == 1


def test_shortlist_of_the_whole_run(spark):
    """What holds of any shortlist: ranks without gaps, capped states, no name twice within the radius."""
    from upland.plans import fullrun

    rows = fullrun.full_run(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and 50 <= len(rows) <= 100
    scores = [r.composite_score for r in sorted(rows, key=lambda r: r["rank"])]
    assert scores == sorted(scores, reverse=True) and 0 <= min(scores) and max(scores) <= 100 and scores[0] - scores[-1] > 1
    states = [r.state_name for r in rows]
    assert len(set(states)) >= 5 and max(states.count(s) for s in set(states)) < 0.5 * len(rows)
    assert sum(not r.village_name.startswith("Village_") for r in rows) >= 0.7 * len(rows)
    assert np.mean([r.multi_signal_confirmed for r in rows]) >= 0.1 and all(r.confidence_score >= 30 for r in rows)
    assert scoring.DARK_WEIGHTS.keys() == {"ndbi_growth_score", "ghsl_change_score", "tower_growth_score", "pop_growth_score"}
