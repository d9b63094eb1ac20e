"""Batched k-means against Spark's own from the same centres, and silhouettes against their definition."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.clustering import KMeans as RowKMeans
from pyspark.mllib.clustering import KMeansModel
from pyspark.sql import functions as F

from upland.operators import clusters


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (150, 3)) for c in ((0, 0, 0), (4, 4, 0), (0, 5, 5), (9, 0, 3))] + [np.zeros((40, 3))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(5).cache()


def test_steps_equal_spark_from_the_same_centres(spark, blobs):
    x, rows = blobs
    rng = np.random.default_rng(2)
    sets = {clusters.Start(k, s): x[rng.choice(len(x), k, replace=False)] for k in (2, 4, 5) for s in range(3)}
    ours = clusters.lloyd(rows, sets)
    cost = {s: p.cost.sum() for s, p in clusters.one_pass(rows, ours).items()}
    points = rows.rdd.map(lambda r: r.x).cache()
    for s, first in sets.items():
        theirs = RowKMeans.train(points, s.k, maxIterations=clusters.STEPS, epsilon=clusters.TOL, initialModel=KMeansModel(list(first)))
        assert cost[s] == pytest.approx(theirs.computeCost(points), rel=1e-6)


def test_best_start_is_as_good_as_sparks(blobs):
    _, rows = blobs
    vectors = rows.select(array_to_vector("x").alias("features")).cache()
    best = clusters.best_of(rows, (3, 4), tuple(range(6)), 3)
    for k in (3, 4):
        theirs = min(KMeans(k=k, seed=s).fit(vectors).summary.trainingCost for s in range(6))
        start = clusters.Start(k, 0)
        assert clusters.one_pass(rows, {start: best[k]})[start].cost.sum() <= theirs * 1.0001


def test_a_step_is_one_job(spark, blobs, monkeypatch):
    _, rows = blobs
    passes, one_pass = [], clusters.one_pass
    monkeypatch.setattr(clusters, "one_pass", lambda r, c: passes.append(len(c)) or one_pass(r, c))
    clusters.best_of(rows, (3, 4, 5), tuple(range(5)), 3)
    assert passes[0] == 15 and len(passes) <= clusters.STEPS + clusters.SEEDINGS + 2 and sorted(passes[3:-1], reverse=True) == passes[3:-1]


def test_reruns_agree(blobs):
    _, rows = blobs
    one, two = (clusters.best_of(r, (3, 5), (0, 1), 3) for r in (rows, rows.repartition(2)))
    assert all(np.allclose(one[k], two[k]) for k in (3, 5))


def test_silhouettes_by_their_definition(spark, blobs):
    x, rows = blobs
    sets = [x[[0, 200, 350]], x[[0, 200, 350, 500]], x[[0]]]
    got = clusters.silhouettes(rows, lambda v: (clusters.assigned(v, c)[0] for c in sets), [3, 4, 1], 3)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    for i, c in enumerate(sets[:2]):
        own = clusters.assigned(x, c)[0]
        value = []
        for r in range(len(x)):
            mean = lambda k, r=r: d2[r][(own == k) & (np.arange(len(x)) != r)].mean()
            inner, outer = mean(own[r]), min(mean(k) for k in range(len(c)) if k != own[r])
            value.append((outer - inner) / max(inner, outer))
        labelled = clusters.with_cluster(rows, c, "prediction").join(rows, "id").select(array_to_vector("x").alias("features"), F.col("prediction").cast("double"))
        assert got[i] == pytest.approx(np.mean(value)) == pytest.approx(ClusteringEvaluator().evaluate(labelled))
    assert np.isnan(got[2])


def test_few_rows_and_none(spark, blobs):
    _, rows = blobs
    assert clusters.best_of(rows.filter("false"), (3,), (0, 1), 3) == {}
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], "id long, x array<double>")
    assert clusters.best_of(same, (3,), (0,), 3)[3].tolist() == [[1.0, 2.0, 3.0]]
