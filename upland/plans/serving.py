"""Serving queries, reports, and JSON parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from upland.operators import scoring, serving
from upland.plans import oracle as o
from upland.plans.features import NAMES, archetype_rules, grown, rounded, scored, shortlist
from upland.sources import jsonsource
from upland.sources import panel as src


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.ranked_whole(scored(spark, sf_dir))


def api_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = serving.listing(ranked(spark, sf_dir), state="BRAND#1", min_score=20.0, max_rank=600, offset=10, limit=25)
    return rounded(page.select("rank", *NAMES, "composite_score"), "composite_score")


def api_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.by_id(src.panel(spark, sf_dir), "7").select(*NAMES, "ntl_2019", "ntl_2024"), "ntl_2019", "ntl_2024")


def states_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.states(scored(spark, sf_dir)), "mean_score")


def archetype_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.archetypes(scored(spark, sf_dir).join(archetype_rules(spark, sf_dir), "id")), "mean_score")


def kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.figures(shortlist(spark, sf_dir)), "best_score", "median_growth")


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.histogram(src.entities(spark, sf_dir).select(F.col("id").cast("double").alias("v")), "v", 20)


def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.entities(spark, sf_dir).groupBy("state_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "state_name").limit(12)


def long_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.lengthen(src.widen(src.dense_panel(spark, sf_dir)), "id"), "value")


def top10_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.round("value", 9).desc(), "id"))
    return rounded(src.dense_panel(spark, sf_dir).withColumn("place", place).filter("place <= 10").select("year", "place", "id", "value"), "value")


def signal_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist(spark, sf_dir).select("id", (F.col("ntl_growth_pct") > 50).alias("ntl"), F.coalesce(F.col("builtup_change") > 0, F.lit(False)).alias("built"), (F.col("ghsl_change") > 0).alias("ghsl"))


def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each weighted part of the shortlist's composites, in long form."""
    rows = shortlist(spark, sf_dir)
    own = scoring.redistribute(scoring.WEIGHTS, rows.columns)
    parts = rows.select("id", *[(F.col(c) * w).alias(c) for c, w in own.items()])
    return rounded(parts.unpivot(["id"], list(own), "part", "points"), "points")


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(serving.coverage(grown(spark, sf_dir), ["ntl_2019", "ntl_2024", "built_2020", "builtup_change", "ghsl_change", "ntl_growth_pct"]), "share")


def json_tags_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonsource.props(src.table(spark, sf_dir, "events")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (api_list_page, api_by_id, states_rollup, archetype_rollup, kpi_row, score_histogram, state_counts, long_melt, top10_per_year, signal_presence, score_components, coverage_report, json_tags_parse)}

_RANKED = f"{o.SCORED}, ranked AS (SELECT *, row_number() OVER (ORDER BY {o.ORDER}) AS rank FROM scored)"


def _archetype_rollup_sql() -> str:
    from upland.plans.features import ORACLE_SQL as features

    head, tail = features["archetype_rules"].rsplit("SELECT id, CASE", 1)
    return f"{head.rstrip()}, lab AS (SELECT id, composite_score, CASE{tail}) SELECT archetype_name, count(*) AS n, round(avg(composite_score), 6) AS mean_score FROM lab GROUP BY 1"


_COVERED = ["ntl_2019", "ntl_2024", "built_2020", "builtup_change", "ghsl_change", "ntl_growth_pct"]
ORACLE_SQL = {
    "api_list_page": f"WITH {_RANKED} SELECT rank, id, village_name, state_name, district_name, round(composite_score, 6) AS composite_score FROM ranked WHERE contains(lower(state_name), 'brand#1') AND composite_score >= 20 AND rank <= 600 ORDER BY ranked.rank LIMIT 25 OFFSET 10",
    "api_by_id": f"WITH {o.PANEL} SELECT id, village_name, state_name, district_name, round(ntl_2019, 6) AS ntl_2019, round(ntl_2024, 6) AS ntl_2024 FROM panel WHERE id::VARCHAR = '7'",
    "states_rollup": f"WITH {_RANKED} SELECT state_name, count(*) AS n, round(avg(composite_score), 6) AS mean_score, min_by(village_name, rank) AS top_village FROM ranked GROUP BY state_name",
    "archetype_rollup": _archetype_rollup_sql(),
    "kpi_row": f"WITH {o.SCORED}, {o.TOP} SELECT count(*) AS n, round(max(composite_score), 6) AS best_score, round(median(ntl_growth_pct), 6) AS median_growth, count(DISTINCT state_name) AS states FROM top",
    "score_histogram": f"WITH {o.ENTITY}, m AS (SELECT min(id)::DOUBLE AS lo, max(id)::DOUBLE AS hi FROM entity) SELECT least(floor((id - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM entity CROSS JOIN m GROUP BY 1",
    "state_counts": f"WITH {o.ENTITY} SELECT state_name, count(*) AS n FROM entity GROUP BY 1 ORDER BY n DESC, state_name LIMIT 12",
    "long_melt": f"WITH {o.DENSE} SELECT id, yr::INT AS year, round(value, 6) AS value FROM long_dense",
    "top10_per_year": f"WITH {o.DENSE}, p AS (SELECT yr::INT AS year, id, value, row_number() OVER (PARTITION BY yr ORDER BY round(value, 9) DESC, id) AS place FROM long_dense) SELECT year, place, id, round(value, 6) AS value FROM p WHERE place <= 10",
    "signal_presence": f"WITH {o.SCORED}, {o.TOP} SELECT id, ntl_growth_pct > 50 AS ntl, coalesce(builtup_change > 0, false) AS built, ghsl_change > 0 AS ghsl FROM top",
    "score_components": f"WITH {o.SCORED}, {o.TOP} SELECT id, 'ntl_growth_log_score' AS part, round(ntl_growth_log_score * (0.30::DOUBLE / 0.45::DOUBLE), 6) AS points FROM top UNION ALL SELECT id, 'ghsl_change_score', round(ghsl_change_score * (0.15::DOUBLE / 0.45::DOUBLE), 6) FROM top",
    "coverage_report": f"WITH {o.GROWN} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NOT NULL)::INT), 6) AS share FROM grown" for c in _COVERED),
    "json_tags_parse": "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2",
}
