"""Points of one place: pairs and components by places against all pairs of points."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from upland.operators import scoring, spatial, validation
from upland.operators.components import components
from upland.sources import panel

SCHEMA = "id long, latitude double, longitude double, name string"


def km(a, b):
    (y1, x1), (y2, x2) = [tuple(map(math.radians, p)) for p in (a, b)]
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("middle", [(20.0, 78.0), (-63.0, 179.8), (88.9, -40.0), (0.0, 0.0)])
def test_named_pairs_against_all_pairs(spark, middle, monkeypatch):
    monkeypatch.setattr(spatial, "CHUNK", 3)
    rng = random.Random(2)
    spots = [(min(90.0, middle[0] + rng.uniform(-1.6, 1.6)), (middle[1] + rng.uniform(-3, 3) + 180) % 360 - 180) for _ in range(60)]
    rows = [(k, *rng.choice(spots), rng.choice("ab")) for k in range(150)] + [(900, None, 1.0, "a"), (901, middle[0], None, "a"), (902, *middle, " ")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.a, r.b): r.km for r in spatial.named_pairs(df, F.trim("name"), 100.0).collect()}
    known = [r for r in rows if r[0] < 900]
    want = {(p[0], q[0]): km(p[1:3], q[1:3]) for p in known for q in known if p[0] < q[0] and p[3] == q[3] and km(p[1:3], q[1:3]) <= 100}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    members, links = spatial.named_links(df, F.trim("name"), 100.0)
    heads = {r.id: r["head"] for r in members.collect()}
    joined = links.unionByName(members.select(F.col("id").alias("a"), F.col("head").alias("b")))
    pairs = spark.createDataFrame(list(want), "a long, b long")
    assert {(r.node, r.component) for r in components(joined).collect()} == {(r.node, r.component) for r in components(pairs).collect()}
    assert heads.keys() == {r[0] for r in known}


def test_one_crowded_place_makes_no_pairs(spark):
    """Three thousand rows of one place are four and a half million pairs, but as many links as rows."""
    df = spark.range(3000).select("id", F.lit(10.0).alias("latitude"), F.when(F.col("id") < 2990, 70.0).otherwise(70.2 + F.col("id")).alias("longitude"), F.lit("x").alias("name"))
    for members, links in (spatial.radius_links(df, 0.3), spatial.named_links(df, F.col("name"), 100.0)):
        assert members.count() == 3000 and links.count() == 0
        kept = scoring.keep_best_linked(df, members, links, [F.desc("id")])
        assert {r.id for r in kept.collect()} == set(range(2989, 3000))


def test_no_side_is_broadcast_by_the_size_of_its_table(spark, sf_dir):
    """A table of few bytes may become many rows before it is joined."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.col("p_name").alias("name"))
    assert "BroadcastHashJoin" not in plan_of(spatial.within_radius(rows, rows, 0.3))
    assert "BroadcastHashJoin" not in plan_of(spatial.named_pairs(rows, F.col("name"), 100.0))


def test_a_component_is_cut_to_a_row_before_it_is_shuffled(spark):
    df = spark.range(40).select("id", (F.col("id") * 7 % 40).alias("s"))
    groups = df.select("id", (F.col("id") % 2).alias("component"))
    kept = scoring.first_of_components(df, groups, [F.desc("s"), F.asc("id")])
    assert {r.id for r in kept.collect()} == {r.id for r in df.collect() if r.s in (39, 38)}
    assert "WindowGroupLimit" in plan_of(kept)


def test_arrays_of_all_draws_are_never_broadcast(spark, monkeypatch):
    plans, real = [], validation.cut
    monkeypatch.setattr(validation, "cut", lambda df, name: (plans.append((name, plan_of(df))), real(df, name))[1])
    df = spark.range(300).select("id", (F.col("id") * 7 % 31).cast("double").alias("latitude"), (F.col("id") * 11 % 37).cast("double").alias("longitude"), (F.col("id") % 5).cast("double").alias("v"))
    validation.moran_permutations(df, "v", 4, draws=12)
    assert "BroadcastHashJoin" not in dict(plans)["statistics"] and "BroadcastHashJoin" not in dict(plans)["edges-of-blocks"]


def test_batches_are_bounded_by_their_bytes(spark, sf_dir):
    """Rows that hold 256 KB each come to a Python worker a few at a time."""
    panel.table(spark, sf_dir, "part")
    rows = spark.range(200).coalesce(1).select("id", F.array_repeat(F.col("id"), 32768).alias("x"))
    most = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"id": [b.num_rows]}) for b in batches), "id long").agg(F.max("id")).first()[0]
    assert most < 64
