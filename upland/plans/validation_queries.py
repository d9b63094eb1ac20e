"""Queries of validation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.operators import scoring, validation
from upland.plans import oracle as o
from upland.plans.features import grown, rounded, scored, shortlist
from upland.plans.fullrun import signals_sql, with_signals
from upland.sources import panel as src

#: Signals of the correlation matrix, and those of the stability test with their weights (fixed values).
SIGNALS = ["ntl_growth_pct", "ntl_trend_slope", "ndbi_growth", "ndbi_trend_slope", "ndvi_trend_slope", "builtup_change", "pop_growth_rate"]
STABLE = {"ntl_growth_log": 0.30, "ndbi_growth": 0.20, "ghsl_change": 0.15, "tower_growth": 0.10}
DRAWS = validation.weight_draws(list(STABLE.values()), 200)


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.spearman(with_signals(spark, sf_dir), SIGNALS)


def state_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.representation(src.entities(spark, sf_dir), shortlist(spark, sf_dir)), "all_pct", "top_pct")


def electrification_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.confound(shortlist(spark, sf_dir))


def moran_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.moran(grown(spark, sf_dir), "ntl_growth_log", 8), "i")


def moran_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation test, with all its shuffles."""
    return rounded(validation.moran_permutations(grown(spark, sf_dir), "ntl_growth_log", 8), "i", "p_value")


def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the shortlist's rows stay under weights drawn around the given ones."""
    rows = with_signals(spark, sf_dir).filter(scoring.is_main())
    return validation.stability(rows, list(STABLE), DRAWS, shortlist(spark, sf_dir).select("id"), 40)


def base_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlist's places by composite among the whole track, ties averaged and cut to whole numbers."""
    rows = scored(spark, sf_dir).select("id", F.round("composite_score", 9).alias("score"))
    return validation.base_rank(rows, "score").join(shortlist(spark, sf_dir).select("id"), "id", "left_semi").select("id", "base_rank")


def moran_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation of the composite itself."""
    return rounded(validation.moran(scored(spark, sf_dir), "composite_score", 8), "i")


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("composite_score", F.coalesce((F.col("builtup_change") > 0).cast("int"), F.lit(0)).alias("label"))
    return rounded(validation.auc(rows.withColumn("composite_score", F.round("composite_score", 9)), "composite_score", "label"), "auc")


QUERIES = {f.__name__: f for f in (spearman_matrix, state_representation, electrification_confound, moran_i, moran_p, rank_stability, base_ranks, moran_composite, auc_rank)}

_PAIRS = [(a, b) for k, a in enumerate(SIGNALS) for b in SIGNALS[k + 1 :]]
_COMPLETE = f"FROM signals WHERE {SIGNALS[0]} IS NOT NULL AND {SIGNALS[1]} IS NOT NULL"
_RHO = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN count(*) >= 50 THEN round(corr(ra, rb), 3) END AS rho "
    f"FROM (SELECT {o.pct_rank(a)} AS ra, {o.pct_rank(b)} AS rb {_COMPLETE} AND {a} IS NOT NULL AND {b} IS NOT NULL)"
    for a, b in _PAIRS
)
_OWN = " UNION ALL ".join(f"SELECT '{s}', '{s}', 1.0::DOUBLE" for s in SIGNALS)
_DRAWN = ", ".join(f"({k}, {', '.join(f'{x!r}::DOUBLE' for x in w)})" for k, w in enumerate(DRAWS))
_LETTERS = "abcd"


def _moran_sql(ctes: str, table: str, value: str) -> str:
    return f"""WITH {ctes}, p AS (SELECT id, latitude, longitude, {value} - (SELECT avg({value}) FROM {table}) AS x FROM {table} WHERE {value} IS NOT NULL),
      d AS (SELECT a.id, b.id AS other, b.x, row_number() OVER (PARTITION BY a.id ORDER BY {o.D2}, b.id) AS rn FROM p a JOIN p b ON a.id <> b.id),
      near AS (SELECT * FROM d WHERE rn <= 8), l AS (SELECT id, avg(x) AS lag FROM near GROUP BY id)"""


ORACLE_SQL = {
    "spearman_matrix": f"WITH {signals_sql()}, r AS ({_RHO}) SELECT a, b, rho FROM r UNION ALL SELECT b, a, rho FROM r UNION ALL {_OWN}",
    "state_representation": f"""WITH {o.SCORED}, {o.TOP}, a AS (SELECT state_name, count(*) AS n FROM entity GROUP BY 1), t AS (SELECT state_name, count(*) AS m FROM top GROUP BY 1),
      j AS (SELECT coalesce(a.state_name, t.state_name) AS state_name, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN t ON a.state_name = t.state_name), s AS (SELECT sum(n) AS sn, sum(m) AS sm FROM j), p AS (SELECT state_name, n / sn * 100 AS ap, m, m / sm * 100 AS tp FROM j CROSS JOIN s)
      SELECT state_name, round(ap, 6) AS all_pct, m AS top_count, round(tp, 6) AS top_pct, round(tp / CASE WHEN ap = 0 THEN 0.001 ELSE ap END, 2) AS over_rep_ratio FROM p""",
    "electrification_confound": f"""WITH {o.SCORED}, {o.TOP}, f AS (SELECT coalesce(ntl_2019, 0) < 0.5 AS low, coalesce(ntl_2024 - ntl_2019, 0) > 0 AND coalesce(coalesce(ntl_2021 - ntl_2019, 0) / nullif(ntl_2024 - ntl_2019, 0), 0) > 0.7 AS front, abs(coalesce(builtup_change, 0)) < 0.01 AS flat FROM top)
      SELECT count(*) AS total, count_if(low) AS low_baseline_count, count_if(front) AS growth_frontloaded_count, count_if(flat) AS flat_builtup_count, count_if(low AND front AND flat) AS electrification_only_risk_count, round(count_if(low AND front AND flat) / nullif(count(*), 0) * 100, 1) AS electrification_only_risk_pct FROM f""",
    "moran_i": _moran_sql(o.GROWN, "grown", "ntl_growth_log") + " SELECT round(sum(p.x * l.lag) / sum(p.x * p.x), 6) AS i, count(*) AS n, 8 AS k FROM p JOIN l ON p.id = l.id",
    "moran_composite": _moran_sql(o.SCORED, "scored", "composite_score") + " SELECT round(sum(p.x * l.lag) / sum(p.x * p.x), 6) AS i, count(*) AS n, 8 AS k FROM p JOIN l ON p.id = l.id",
    "moran_p": _moran_sql(o.GROWN, "grown", "ntl_growth_log")
    + """, one AS (SELECT id, x, row_number() OVER (ORDER BY md5(id::VARCHAR || '-0-42'), id) AS place FROM p),
      drawn AS (SELECT one.*, unnest(range(1, 1000)) AS draw FROM one),
      moved AS (SELECT draw, x, row_number() OVER (PARTITION BY draw ORDER BY md5(id::VARCHAR || '-' || draw::VARCHAR || '-42'), id) AS place FROM drawn),
      given AS (SELECT d.draw, d.id, m.x FROM drawn d JOIN moved m ON d.draw = m.draw AND d.place = m.place),
      lags AS (SELECT g.draw, n.id, avg(g.x) AS lag FROM near n JOIN given g ON n.other = g.id GROUP BY 1, 2),
      stats AS (SELECT g.draw, sum(g.x * lag) / sum(g.x * g.x) AS i FROM given g JOIN lags ON g.draw = lags.draw AND g.id = lags.id GROUP BY 1),
      seen AS (SELECT sum(p.x * l.lag) / sum(p.x * p.x) AS i FROM p JOIN l ON p.id = l.id)
      SELECT round(avg((stats.i >= seen.i)::INT), 6) AS p_value, round(any_value(seen.i), 6) AS i FROM stats CROSS JOIN seen""",
    "rank_stability": f"""WITH {signals_sql()}, {o.SCORED_AFTER_GROWN}, {o.TOP}, m AS (SELECT id, state_name, """
    + ", ".join(f"{o.pct_rank(s)} AS {k}" for k, s in zip(_LETTERS, STABLE, strict=True))
    + f""" FROM signals WHERE is_main), w(draw, wa, wb, wc, wd) AS (VALUES {_DRAWN}),
      s AS (SELECT id, state_name, draw, round(a * wa + b * wb + c * wc + d * wd, 9) AS s FROM m CROSS JOIN w),
      pl AS (SELECT *, row_number() OVER (PARTITION BY draw, state_name ORDER BY s DESC, id) AS within FROM s),
      rk AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY s DESC, id) AS rank FROM pl WHERE within <= 40),
      times AS (SELECT id, count(*) AS times FROM rk WHERE rank <= (SELECT count(*) FROM top) GROUP BY id)
      SELECT top.id, round(coalesce(times, 0) / {len(DRAWS)} * 100, 1) AS inclusion_pct FROM top LEFT JOIN times ON top.id = times.id""",
    "base_ranks": f"""WITH {o.SCORED}, {o.TOP}, v AS (SELECT id, round(composite_score, 9) AS v FROM scored),
      r AS (SELECT id, floor(rank() OVER (ORDER BY v DESC) + (count(*) OVER (PARTITION BY v) - 1) / 2.0)::BIGINT AS base_rank FROM v) SELECT id, base_rank FROM r WHERE id IN (SELECT id FROM top)""",
    "auc_rank": f"""WITH {o.SCORED}, r AS (SELECT coalesce((builtup_change > 0)::INT, 0) AS label, round(composite_score, 9) AS cs FROM scored), k AS (SELECT label, rank() OVER (ORDER BY cs) + (count(*) OVER (PARTITION BY cs) - 1) / 2.0 AS rk FROM r)
      SELECT round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS auc FROM k""",
}
