"""Components against a plain union-find, on every path of the operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from upland.operators import components as cc


def by_hand(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


def shapes():
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(3000)]
    rng.shuffle(chain)
    star = [(5000, 5001 + k) for k in range(2000)]
    loose = [(rng.randrange(8000, 12000), rng.randrange(8000, 12000)) for _ in range(1500)]
    return chain + star + loose + loose[:50] + [(7, 7), (None, 3), (4, None), (7999, 7999)]


@pytest.mark.parametrize(("task", "held"), [(1 << 20, 1 << 20), (1 << 20, 60), (4000, 1 << 20), (10, 1 << 20), (10, 60)])
def test_against_union_find(spark, monkeypatch, task, held):
    monkeypatch.setattr(cc, "HELD", held)
    edges = shapes()
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = cc.components(df, task=task).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == by_hand(edges)


def test_names_and_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z")], "a string, b string")
    assert {r.node: r.component for r in cc.components(df).collect()} == {"a": "a", "b": "a", "c": "a", "z": "z", "é": "z"}
    assert cc.components(df.filter("false")).collect() == []


def test_long_chain_writes_few_tables(spark, monkeypatch):
    """What 30,000 links in order of place cost: few tables, and few rows beyond the forests."""
    written, cut = [], cc.cut
    monkeypatch.setattr(cc, "cut", lambda df, name: written.append((name, out := cut(df, name))) or out)
    chain = spark.range(0, 30_000, numPartitions=8).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert cc.components(chain).filter("component <> 0").isEmpty() and len(written) == 2
    written.clear()
    assert cc.components(chain, task=20_000).filter("component <> 0").isEmpty()
    rows = Counter({name: df.count() for name, df in written})
    assert len(written) == 4 and rows["forests"] <= 30_000 and rows["border-components"] < 50
