"""Learned queries: amplifier, clusters, attribution. Their values are the engine's own, so only rows are compared, but
for a model that is saved and loaded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.operators import clusters, ml, scoring
from upland.plans import oracle as o
from upland.plans.features import grown, rounded
from upland.plans.fullrun import with_signals
from upland.sources.store import cut, new_folder

SIGNALS = ["ntl_growth_log", "builtup_change", "ghsl_change", "ntl_2024"]
#: Signals that entities are clustered by.
PROFILE = ["ntl_growth_pct", "ndbi_growth", "ghsl_change", "tower_growth", "dist_city_km", "dist_highway_km"]


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(grown(spark, sf_dir).filter(scoring.is_main()), "main-track")


def gbt_amplifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ml.amplify(_main(spark, sf_dir), SIGNALS).select("id", "ml_growth_prob"), "ml_growth_prob")


def kmeans_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the main track and their names; rules name the entities if the clusters say nothing."""
    rows = with_signals(spark, sf_dir).filter(scoring.is_main()).withColumn("ntl_breakpoint_year", F.lit(None).cast("int"))
    rows = cut(rows.withColumn("rule_name", scoring.archetype()), "profiles")
    return ml.named_clusters(rows, PROFILE, "rule_name").select("id", "cluster", "archetype_name")


def tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.attribute(_main(spark, sf_dir), SIGNALS).select("id", "top1", "top2", "top3")


def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amplifier saved and loaded gives the same probabilities."""
    return rounded(ml.round_trip(_main(spark, sf_dir), SIGNALS, new_folder(spark, "model")), "most_apart")


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Lloyd step of the main track from given centres, the means of four groups of ids: what each centre then has."""
    rows = _main(spark, sf_dir).select("id", F.array(F.coalesce("ntl_growth_log", F.lit(0.0)), F.coalesce(F.col("ghsl_change").cast("double"), F.lit(0.0)) / 97).alias("x"))
    rows = cut(rows, "step-rows")
    start = clusters.Start(4, 0)
    means = rows.groupBy((F.col("id") % 4).alias("g")).agg(F.avg(F.col("x")[0]).alias("a"), F.avg(F.col("x")[1]).alias("b")).orderBy("g").collect()  # four rows
    centres = np.array([[r["a"], r["b"]] for r in means]).reshape(-1, 2)
    found = clusters.one_pass(rows, {start: centres})[start]
    after = clusters.moved(centres, found)
    listed = [(k, int(found.n[k]), float(found.cost[k]), *map(float, after[k])) for k in range(len(centres))]
    return rounded(spark.createDataFrame(listed, "cluster int, n long, cost double, growth double, settlement double"), "cost", "growth", "settlement", places=5)


def track_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the two tracks part the entities by their first and last night lights."""
    rows = grown(spark, sf_dir).select("ntl_2019", "ntl_2024", F.when(scoring.is_main(), 1).otherwise(0).alias("track"))
    return rounded(clusters.labelled_silhouette(rows, ["ntl_2019", "ntl_2024"], F.col("track"), 2), "silhouette", places=5)


QUERIES = {f.__name__: f for f in (kmeans_step, track_silhouette, gbt_amplifier, kmeans_archetypes, tree_attribution, model_round_trip)}
ORACLE_SQL: dict[str, str] = {
    "kmeans_step": f"""WITH {o.GROWN}, p AS (SELECT id, coalesce(ntl_growth_log, 0)::DOUBLE AS a, coalesce(ghsl_change::DOUBLE, 0) / 97 AS b FROM grown WHERE is_main),
      c AS (SELECT (id % 4)::INT AS k, avg(a) AS a, avg(b) AS b FROM p GROUP BY 1),
      d AS (SELECT p.id, p.a, p.b, c.k, c.a AS ca, c.b AS cb, (p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b) AS d2 FROM p CROSS JOIN c),
      m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, k) AS rn FROM d), s AS (SELECT k, count(*) AS n, sum(d2) AS cost, avg(a) AS a, avg(b) AS b FROM m WHERE rn = 1 GROUP BY k)
      SELECT c.k AS cluster, coalesce(n, 0) AS n, round(coalesce(cost, 0), 5) AS cost, round(coalesce(s.a, c.a), 5) AS growth, round(coalesce(s.b, c.b), 5) AS settlement FROM c LEFT JOIN s ON c.k = s.k""",
    "track_silhouette": f"""WITH {o.GROWN}, p AS (SELECT id, ntl_2019 AS a, ntl_2024 AS b, is_main AS t FROM grown WHERE ntl_2019 IS NOT NULL AND ntl_2024 IS NOT NULL),
      d AS (SELECT x.id, x.t, avg((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) FILTER (WHERE x.t = y.t AND x.id <> y.id) AS inside,
        avg((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) FILTER (WHERE x.t <> y.t) AS outside FROM p x CROSS JOIN p y GROUP BY x.id, x.t)
      SELECT round(avg(CASE WHEN inside IS NULL THEN 0 ELSE coalesce((outside - inside) / nullif(greatest(outside, inside), 0), 0) END), 5) AS silhouette, count(*) AS n FROM d""",
    "model_round_trip": f"WITH {o.GROWN} SELECT count(*) AS n, 0.0::DOUBLE AS most_apart FROM grown WHERE is_main",
}
