"""Gradient-boosted amplifier, named k-means clusters with a silhouette choice, Shapley values of tree ensembles."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.functions import ranks, series
from upland.operators import clusters
from upland.sources.store import cut


def with_label(df: DataFrame, signals: list[str], share: float = 0.90, least: int = 2, voters: int = 4) -> DataFrame:
    """label is 1 where at least `least` of the first `voters` signals exceed their own quantile."""
    high = ranks.quantiles(df, {s: [share] for s in signals[:voters]})
    votes = [F.coalesce((F.col(s) > F.lit(q[0]).cast("double")).cast("int"), F.lit(0)) for s, q in high.items()]
    return df.withColumn("label", (series.total(votes) >= least).cast("double"))


def imputed(df: DataFrame, signals: list[str]) -> DataFrame:
    """Missing values become the median, or 0 where there is none."""
    middle = ranks.quantiles(df, {s: [0.5] for s in signals})
    return df.withColumns({f"{s}_full": F.coalesce(s, F.lit(middle[s][0] or 0.0)) for s in signals})


def fit_amplifier(labelled: DataFrame, signals: list[str], trees: int = 200, depth: int = 4, step: float = 0.05, subsample: float = 0.8) -> PipelineModel:
    stages = [
        VectorAssembler(inputCols=[f"{s}_full" for s in signals], outputCol="raw"),
        RobustScaler(inputCol="raw", outputCol="features"),
        GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=42, labelCol="label"),
    ]
    return Pipeline(stages=stages).fit(labelled)


def amplify(df: DataFrame, signals: list[str], trees: int = 200, least_positives: int = 20) -> DataFrame:
    """ml_growth_prob from 0 to 100; null with fewer than two signals or too few positives."""
    have = [s for s in signals if s in df.columns]
    if len(have) < 2:
        return df.withColumn("ml_growth_prob", F.lit(None).cast("double"))
    rows = imputed(with_label(df, have), have)
    if rows.filter("label = 1").limit(least_positives).count() < least_positives:
        return df.withColumn("ml_growth_prob", F.lit(None).cast("double"))
    scored = fit_amplifier(rows, have, trees).transform(rows)
    return scored.withColumn("ml_growth_prob", vector_to_array("probability").getItem(1) * 100).drop("raw", "features", "rawPrediction", "probability", "prediction")


def cluster(df: DataFrame, signals: list[str], ks: tuple[int, ...] = (3, 4, 5, 6), seeds: tuple[int, ...] = tuple(range(10))) -> tuple[DataFrame, list[list[float]]]:
    """The rows with their cluster, and the clusters' centres: for each k the start with the least cost, of the ks the
    best silhouette. Values are scaled by median and quartiles. All starts of all ks go through the rows together."""
    rows = imputed(df, signals)
    stages = [VectorAssembler(inputCols=[f"{s}_full" for s in signals], outputCol="raw"), RobustScaler(inputCol="raw", outputCol="features", withCentering=True)]
    ready = Pipeline(stages=stages).fit(rows).transform(rows).withColumn("x", vector_to_array("features"))
    ready = cut(ready.select(*df.columns, "x"), "profiles")
    best = clusters.best_of(ready, ks, seeds, len(signals))
    if not best:
        return ready.withColumn("cluster", F.lit(0)).drop("x"), []
    sets = [best[k] for k in ks]
    scores = clusters.silhouettes(ready, lambda x: (clusters.assigned(x, c)[0] for c in sets), [len(c) for c in sets], len(signals))
    first = max(range(len(sets)), key=lambda i: (not np.isnan(scores[i]), scores[i], -i))
    return clusters.with_cluster(ready, sets[first]), sets[first].tolist()


#: Share of all rows beyond which a cluster is the background, its name, and weights of the growth that clusters are
#: taken in the order of (fixed values).
BACKGROUND, BACKGROUND_NAME = 0.40, "Steady Grower"
GROWTH = {"ntl_growth_pct": 0.4, "ndbi_growth": 0.3, "ghsl_change": 0.2, "tower_growth": 0.1}


class Profile(NamedTuple):
    """Signals in which a cluster's centre lies above the centres' mean, and those that are there in which it lies below."""

    above: set[str]
    below: set[str]


#: Names of clusters and what must hold of the profile; the first that is free is taken (fixed values).
CLUSTER_RULES: list[tuple[str, Callable[[Profile], bool]]] = [
    ("Urban Fringe Surge", lambda p: {"ntl_growth_pct", "ndbi_growth"} <= p.above and "dist_city_km" in p.below),
    ("Construction Boom", lambda p: {"ntl_growth_pct", "ndbi_growth"} <= p.above),
    ("Industrial Corridor", lambda p: "ntl_growth_pct" in p.above and "dist_highway_km" in p.below),
    ("Rural Electrification", lambda p: "ntl_growth_pct" in p.above and "ndbi_growth" not in p.above),
    ("Agricultural Shift", lambda p: "ntl_growth_pct" not in p.above and "ndbi_growth" in p.above),
    ("Connectivity-Led Growth", lambda p: "tower_growth" in p.above and not {"ntl_growth_pct", "ndbi_growth"} & p.above),
]
#: Names of clusters that no rule fits, by descending growth (fixed values).
SPARE_NAMES = ["Active Growth", "Emerging Growth", "Latent Potential", "Stable Base", "Low Activity"]


def profiles(centres: list[list[float]], signals: list[str]) -> list[Profile]:
    x = np.array(centres, float).reshape(len(centres), len(signals))
    apart = np.sign(x - x.mean(0)) if len(x) else x
    return [Profile({s for s, v in zip(signals, row, strict=True) if v > 0}, {s for s, v in zip(signals, row, strict=True) if v < 0}) for row in apart]


def cluster_names(centres: list[list[float]], sizes: list[int], signals: list[str]) -> list[str]:
    """A name for each cluster by how its centre compares with the others', each name once; a signal that isn't there counts
    as neither above nor below.

    A cluster with most rows is the background unless a rule names it; clusters choose in the order of their growth,
    and one that neither a rule nor the background names takes a spare name, if any is left."""
    at = np.array(centres, float).reshape(len(centres), len(signals))
    growth = sum((w * at[:, signals.index(s)] for s, w in GROWTH.items() if s in signals), np.zeros(len(at)))
    order = np.argsort(-np.round(growth, 12), kind="stable").tolist()  # ties to the last bits go by number
    found = profiles(centres, signals)
    crowd = next((k for k, n in enumerate(sizes) if n > BACKGROUND * sum(sizes)), None)
    given: dict[int, str] = {} if crowd is None else {crowd: BACKGROUND_NAME}
    taken = set(given.values())
    fitting = {k: [name for name, holds in CLUSTER_RULES if holds(found[k])] for k in order}
    for choices in (fitting, dict.fromkeys(order, SPARE_NAMES)):
        for k in order:
            free = next((name for name in choices.get(k, []) if name not in taken), None)
            if free and (choices is fitting or k not in given):
                given[k] = free
                taken.add(free)
    return [given.get(k, "") for k in range(len(centres))]


def named_clusters(df: DataFrame, signals: list[str], rule: str, **options) -> DataFrame:
    """The rows with cluster and archetype_name, which is the column `rule` where all clusters bear one name."""
    rows, centres = cluster(df, signals, **options)
    counts = {r["cluster"]: r["n"] for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most six
    names = cluster_names(centres, [counts.get(k, 0) for k in range(len(centres))], signals) or [""]
    named = rows.withColumn("archetype_name", F.element_at(F.array(*map(F.lit, names)), F.col("cluster") + 1))
    return guarded_names(named, "archetype_name", rule)


def guarded_names(df: DataFrame, name: str, rule: str) -> DataFrame:
    """Clusters that bear fewer than two names say nothing; then each row takes its rule's name."""
    if df.select(name).distinct().limit(2).count() < 2:
        return df.withColumn(name, F.col(rule))
    return df


def attribute(df: DataFrame, signals: list[str], trees: int = 200, top: int = 3) -> DataFrame:
    """top1.. of each row: the signals with the largest Shapley values, either way, for the ensemble's sum.

    Signals that aren't known count by the shares in which the training rows went at a split, as is usual for trees.
    A leaf's part is then a product over the signals of its path, so its Shapley values are sums over subsets of these
    alone. The leaves, a small table, are a broadcast variable."""
    have = [s for s in signals if s in df.columns]
    rows = imputed(with_label(df, have), have)
    model = fit_amplifier(rows, have, trees).stages[-1]
    forest = [(w * value, path) for w, t in zip(model.treeWeights, model.trees, strict=True) for value, path in leaves(t)]
    sent, n = df.sparkSession.sparkContext.broadcast(forest), len(have)

    @F.pandas_udf("array<string>")
    def best(x: pd.Series) -> pd.Series:
        credit = shapley(np.stack(x.to_numpy()), sent.value, n)
        order = np.argsort(-np.abs(credit), axis=1, kind="stable")[:, :top]
        return pd.Series([[have[i] for i in row] for row in order])

    named = fit_scaler(rows, have).withColumn("tops", best(vector_to_array("features"))).drop("raw", "features")
    return named.withColumns({f"top{k + 1}": F.get("tops", k) for k in range(top)}).drop("tops")


Path = dict[int, tuple[float, float, float]]


def shapley(x: np.ndarray, forest: list[tuple[float, Path]], n: int) -> np.ndarray:
    """Shapley values of `n` signals for each row of `x`; a leaf's path has for each signal on it the range (low, high]
    that leads to the leaf and the share of training rows that its splits let through."""
    out = np.zeros((len(x), n))
    for value, path in forest:
        signals = list(path)
        inside = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high, _) in path.items()}
        for f in signals:
            others, total = [g for g in signals if g != f], np.zeros(len(x))
            for size in range(len(others) + 1):
                weight = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(signals))
                for known in combinations(others, size):
                    product = np.full(len(x), weight)
                    for g in others:
                        product *= inside[g] if g in known else path[g][2]
                    total += product
            out[:, f] += value * (inside[f] - path[f][2]) * total
    return out


def leaves(tree) -> list[tuple[float, Path]]:
    """Value and path of each leaf of a fitted tree."""
    out: list[tuple[float, Path]] = []

    def walk(node, path: Path) -> None:
        if node.subtreeDepth() == 0:
            out.append((node.prediction(), path))
            return
        split, whole = node.split(), node.impurityStats().rawCount()
        f, edge = split.featureIndex(), split.threshold()
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, ends in ((node.leftChild(), (low, min(high, edge))), (node.rightChild(), (max(low, edge), high))):
            walk(child, path | {f: (*ends, share * child.impurityStats().rawCount() / whole)})

    walk(tree._call_java("rootNode"), {})
    return out


def round_trip(df: DataFrame, signals: list[str], folder: str, trees: int = 200) -> DataFrame:
    """One row: how many rows the amplifier scores, and the most by which one that was saved and loaded differs."""
    rows = imputed(with_label(df, signals), signals)
    model = fit_amplifier(rows, signals, trees)
    model.write().overwrite().save(folder)
    probability = lambda m, out: m.transform(rows).select("id", vector_to_array("probability").getItem(1).alias(out))
    both = probability(model, "fitted").join(probability(PipelineModel.load(folder), "loaded"), "id")
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("fitted") - F.col("loaded"))).alias("most_apart"))


def fit_scaler(rows: DataFrame, signals: list[str]) -> DataFrame:
    stages = [VectorAssembler(inputCols=[f"{s}_full" for s in signals], outputCol="raw"), RobustScaler(inputCol="raw", outputCol="features")]
    return Pipeline(stages=stages).fit(rows).transform(rows)
