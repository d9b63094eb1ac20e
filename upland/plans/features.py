"""Queries of panel features, scores, joins, tracks and shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from upland.functions import ranks, series
from upland.operators import scoring
from upland.plans import oracle as o
from upland.sources import panel as src
from upland.sources.store import cut

NAMES = ["id", "village_name", "state_name", "district_name"]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_growth(src.panel(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored_main(src.panel(spark, sf_dir))


def shortlist(spark: SparkSession, sf_dir: str, n: int = 100, share: float = 0.40) -> DataFrame:
    return scoring.capped(scored(spark, sf_dir), n, share)


def entity_panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = src.widen(src.dense_panel(spark, sf_dir))
    return rounded(src.entities(spark, sf_dir).join(wide, "id", "left"), *src.NTL, "latitude", "longitude")


def growth_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grown(spark, sf_dir).select("id", "ntl_growth_pct", "ntl_growth_log", "builtup_change", "ghsl_change"), "ntl_growth_pct", "ntl_growth_log", "builtup_change", "ghsl_change")


def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = src.gappy_panel(spark, sf_dir).groupBy("id").agg(F.count("value").alias("n_years"), F.regr_slope("value", "year").alias("slope"))
    return rounded(fit.withColumn("slope", F.when(F.col("n_years") >= 3, F.col("slope"))), "slope", places=9)  # six places would round ties


def ols_trend_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.widen(src.gappy_panel(spark, sf_dir)).select("id", series.trend()[0].alias("slope")), "slope", places=9)


def changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.widen(src.dense_panel(spark, sf_dir)).withColumn("c", series.changepoint())
    return rounded(rows.select("id", F.col("c.year").alias("ntl_breakpoint_year"), F.col("c.pre").alias("ntl_pre_slope"), F.col("c.post").alias("ntl_post_slope"), (F.col("c.post") - F.col("c.pre")).alias("ntl_acceleration")), "ntl_pre_slope", "ntl_post_slope", "ntl_acceleration", places=8)  # slopes have up to seven places, so six would round ties


def pct_rank_nulls_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.with_pct_rank(src.panel(spark, sf_dir).select("id", "ghsl_change"), "ghsl_change", "pct"), "ghsl_change", "pct")


def minmax_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grown(spark, sf_dir).select("id", "ntl_growth_log", "ghsl_change", F.lit(None).cast("double").alias("missing"), F.lit(7.0).alias("flat"))
    rows = ranks.with_minmax_scores(cut(rows, "signals"), {c: f"{c}_score" for c in ("ntl_growth_log", "ghsl_change", "missing", "flat")})
    return rounded(rows.select("id", "ntl_growth_log_score", "ghsl_change_score", "missing_score", "flat_score"), "ntl_growth_log_score", "ghsl_change_score", "flat_score")


def zscore_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(src.panel(spark, sf_dir).select("id", "state_name", "ghsl_change"), "settlement")
    return rounded(ranks.with_zscore(rows, "ghsl_change", "state_name", "ghsl_change_z").drop("ghsl_change"), "ghsl_change_z")


def track_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.panel(spark, sf_dir).select("id", F.when(scoring.is_main(), "main").otherwise("dark").alias("track"))


def left_join_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.entities(spark, sf_dir).select("id", "village_name").join(src.settled(spark, sf_dir), "id", "left"), "ghsl_2015", "ghsl_2020")


def full_outer_builtup(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = src.built_up(spark, sf_dir)
    return rounded(first.join(second, "id", "outer").withColumn("builtup_change", F.col("built_2021") - F.col("built_2020")), "built_2020", "built_2021", "builtup_change")


def semi_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.entities(spark, sf_dir).select(*NAMES).join(shortlist(spark, sf_dir).select("id"), "id", "left_semi")


def anti_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.entities(spark, sf_dir).select(*NAMES).join(shortlist(spark, sf_dir).select("id"), "id", "left_anti")


def indicator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts of all entities, marked by whether the shortlist has any."""
    left = src.entities(spark, sf_dir).select(scoring.label_key(F.col("district_name")).alias("district_key")).distinct()
    right = shortlist(spark, sf_dir).select(scoring.label_key(F.col("district_name")).alias("district_key")).distinct().withColumn("hit", F.lit(1))
    return left.join(right, "district_key", "left").select("district_key", F.when(F.col("hit").isNotNull(), "both").otherwise("left_only").alias("found"))


def composite_redistribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("id", "ntl_growth_log_score", "ghsl_change_score", "composite_score"), "ntl_growth_log_score", "ghsl_change_score", "composite_score")


def votes_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return rows.select("id", scoring.votes(rows.columns).alias("votes")).withColumn("multi_signal_confirmed", F.col("votes") >= 2)


def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grown(spark, sf_dir).filter(scoring.is_main()).select("id", "ntl_growth_pct", "builtup_change", "ghsl_change", F.lit(None).cast("double").alias("s1_vv_delta"))
    out = scoring.uncertainty(rows, ["ntl_growth_pct", "builtup_change", "ghsl_change", "s1_vv_delta", "ndbi_growth"])
    return out.select("id", "confidence_score", "signals_active", "signals_attempted", "inter_signal_agreement")


def district_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).select("id", "district_name", "composite_score")
    ranked = ranks.with_pct_rank_within(rows, F.round("composite_score", 9), ["district_name"], "district_rank_pct")
    return rounded(ranked.drop("composite_score"), "district_rank_pct")


def state_cap_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scoring.ranked(shortlist(spark, sf_dir))
    return rounded(top.select("rank", *NAMES, "composite_score", "ntl_2019", "ntl_2024", "ntl_growth_pct"), "composite_score", "ntl_2019", "ntl_2024", "ntl_growth_pct")


def state_cap_tight(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = scoring.ranked(scoring.capped(scored(spark, sf_dir), 50, 0.05))
    return rounded(top.select("rank", "id", "state_name", "composite_score"), "composite_score")


def dark_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark = scoring.dark_track(src.panel(spark, sf_dir))
    return rounded(scoring.ranked(dark.orderBy(*scoring.order_of()).limit(50)).select("rank", "id", "composite_score"), "composite_score")


def union_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = scored(spark, sf_dir).select("id", "ntl_growth_pct", "ghsl_change_score", "composite_score", F.lit("main").alias("track"))
    dark = scoring.dark_track(src.panel(spark, sf_dir)).select("id", "composite_score", F.lit("dark").alias("track"))
    return rounded(main.unionByName(dark, allowMissingColumns=True), "ntl_growth_pct", "ghsl_change_score", "composite_score")


def linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.widen(src.gappy_panel(spark, sf_dir))
    return rows.select("id", *[F.round(c, 4).alias(f"ntl_linear_{2024 + h}") for h, c in enumerate(_linear(), 1)])


def _linear(ahead: int = 3) -> list:
    slope, intercept, _ = series.trend(least=2)
    at = lambda h: intercept + slope * (2024 + h)
    return [F.when(at(h) < 0, 0.0).otherwise(at(h)) for h in range(1, ahead + 1)]


def holt_damped_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.widen(src.gappy_panel(spark, sf_dir)).withColumn("hw", series.damped_holt())
    return rows.select("id", *[F.round(F.get("hw", h - 1), 4).alias(f"ntl_hw_{2024 + h}") for h in (1, 2, 3)])


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.widen(src.gappy_panel(spark, sf_dir)).withColumns({"hw": series.damped_holt(), "line": F.array(*_linear())})
    mean = lambda a, b: F.coalesce((a + b) / 2, a, b)
    return rows.select("id", *[F.round(mean(F.get("line", h - 1), F.get("hw", h - 1)), 4).alias(f"ntl_forecast_{2024 + h}") for h in (1, 2, 3)])


def rising_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks 100 to 2000 by steepest trend, with the score that its percent rank would lift them to."""
    rows = cut(scoring.ranked_whole(scored(spark, sf_dir).withColumn("ntl_trend_slope", series.trend()[0])), "ranked")
    best = rows.filter("rank <= 100").agg(F.min("composite_score").alias("hundredth"))
    stars = ranks.with_pct_rank(rows.filter(F.col("rank").between(100, 2000)), "ntl_trend_slope", "pct")
    lifted = stars.crossJoin(F.broadcast(best)).withColumn("projected_score_2027", F.col("composite_score") + F.col("pct") / 100 * 20)  # one row
    lifted = lifted.withColumn("likely_top100_2027", F.col("projected_score_2027") > F.col("hundredth"))
    top = lifted.orderBy(F.round("ntl_trend_slope", 9).desc(), "id").limit(50)
    return rounded(top.select("id", "rank", "ntl_trend_slope", "projected_score_2027", "likely_top100_2027"), "ntl_trend_slope", "projected_score_2027")


def archetype_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("c", series.changepoint())
    rows = rows.withColumns({"ntl_breakpoint_year": F.col("c.year"), "ntl_acceleration": F.col("c.post") - F.col("c.pre"), "ndbi_growth": F.col("builtup_change"), "tower_growth": F.lit(None).cast("double"), "dist_city_km": F.pmod("id", F.lit(120)).cast("double"), "dist_highway_km": F.lit(None).cast("double")})
    return rows.select("id", scoring.archetype().alias("archetype_name"))


def groundtruth_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access by state, averaged over normalised names, joined to growth; Brand#1x states have no row."""
    access = src.table(spark, sf_dir, "supplier").join(src.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    access = access.groupBy(F.concat(F.lit("brand#"), (F.col("n_nationkey") % 4 + 2).cast("string"), (F.col("n_nationkey") % 5 + 1).cast("string")).alias("key")).agg((F.sum(F.round(F.col("s_acctbal") * 100).cast("bigint")) / F.count(F.lit(1)) / 10000.0).alias("access"))
    rows = grown(spark, sf_dir).withColumn("key", scoring.label_key(F.col("state_name"))).join(access, "key", "left")
    return rows.select("id", F.round("access", 6).alias("access"), scoring.groundtruth(F.col("access"), F.col("ntl_growth_pct")).alias("category"))


def per_state_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("state_name").orderBy(*scoring.order_of()))
    return rounded(scored(spark, sf_dir).withColumn("place", place).filter("place <= 3").select("state_name", "place", "id", "composite_score"), "composite_score")


QUERIES = {f.__name__: f for f in (
    entity_panel_wide, growth_signals, ols_trend, ols_trend_wide, changepoint, pct_rank_nulls_bottom, minmax_score, zscore_by_state, track_split, left_join_optional, full_outer_builtup,
    semi_shortlist, anti_losers, indicator_join, composite_redistribute, votes_confirmed, uncertainty, district_rank, state_cap_topn, state_cap_tight, dark_track, union_scored,
    linear_forecast, holt_damped_forecast, ensemble, rising_stars, archetype_rules, groundtruth_classify, per_state_topk,
)}

_R = lambda *cs, p=6: ", ".join(f"round({c}, {p}) AS {c}" for c in cs)
_NTL = [f"ntl_{y}" for y in o.YEARS]
_KEY = "replace(replace(lower(trim({})), ' ', ''), '-', '')"


def changepoint_sql() -> str:
    """Segment fits with the whole segment's years, unrolled."""
    years, parts = list(o.YEARS), []
    for k in range(2, 5):
        cols, terms = [], []
        for tag, ys in (("a", years[:k]), ("b", years[k:])):
            mid = sum(ys) / len(ys)
            n = " + ".join(f"(ntl_{y} IS NOT NULL)::INT" for y in ys)
            mean = f"(({' + '.join(f'coalesce(ntl_{y}, 0)' for y in ys)}) / nullif({n}, 0))"
            s = f"(({' + '.join(f'coalesce(ntl_{y} - {mean}, 0) * ({y - mid})::DOUBLE' for y in ys)}) / {sum((y - mid) ** 2 for y in ys)}::DOUBLE)"
            cols += [f"{n} AS n{tag}", f"{s} AS s{tag}"]
            terms += [f"pow(coalesce(ntl_{y} - ({s} * ({y - mid})::DOUBLE + {mean}), 0), 2)" for y in ys]
        parts.append(f"SELECT id, {years[k]} AS yr, {', '.join(cols)}, {' + '.join(terms)} AS rss FROM dense")
    return f"WITH {o.DENSE}, opts AS ({' UNION ALL '.join(parts)}), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(rss, 9), yr) AS rn FROM opts WHERE na >= 2 AND nb >= 2)"


def _interpolated() -> str:
    """Gaps filled linearly, ends clamped; long form, then six columns."""
    return f"""{o.GAPPY}, grid AS (SELECT g.id, y.yr, l.value FROM gappy g CROSS JOIN (SELECT unnest(range(2019, 2025)) AS yr) y LEFT JOIN long_gappy l ON l.id = g.id AND l.yr = y.yr),
    near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN yr END IGNORE NULLS) OVER w AS y0, last_value(value IGNORE NULLS) OVER w AS v0,
      first_value(CASE WHEN value IS NOT NULL THEN yr END IGNORE NULLS) OVER x AS y1, first_value(value IGNORE NULLS) OVER x AS v1 FROM grid
      WINDOW w AS (PARTITION BY id ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY id ORDER BY yr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    full_rows AS (SELECT id, yr, coalesce(value, CASE WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN v0 + (v1 - v0) * ((yr - y0)::DOUBLE / (y1 - y0)) END, v0, v1) AS v, value FROM near),
    filled AS (SELECT id, count(value) AS n, {', '.join(f'max(CASE WHEN yr = {y} THEN v END) AS y{i}' for i, y in enumerate(o.YEARS))} FROM full_rows GROUP BY id),
    h0 AS (SELECT *, y0 AS l0, y1 - y0 AS t0 FROM filled)""" + "".join(
        f", h{k} AS (SELECT *, 0.2 * (l{k} - l{k - 1}) + 0.8::DOUBLE * 0.9 * t{k - 1} AS t{k} FROM (SELECT *, 0.5::DOUBLE * y{k} + 0.5::DOUBLE * (l{k - 1} + 0.9::DOUBLE * t{k - 1}) AS l{k} FROM h{k - 1}))" for k in range(1, 6)
    )


_HW = lambda h: f"CASE WHEN n >= 3 THEN greatest(l5 + {0.9 ** h}::DOUBLE * t5, 0) END"
_LIN_CTE = "lin AS (SELECT id, regr_slope(value, yr) AS m, regr_intercept(value, yr) AS b, count(*) AS k FROM long_gappy GROUP BY id)"
_LIN = lambda h: f"CASE WHEN k >= 2 THEN greatest(m * {2024 + h} + b, 0) END"
_ACCESS = """acc AS (SELECT 'brand#' || (n_nationkey % 4 + 2)::VARCHAR || (n_nationkey % 5 + 1)::VARCHAR AS key, sum(CAST(round(s_acctbal * 100) AS BIGINT)) / count(*) / 10000.0 AS access
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""

ORACLE_SQL = {
    "entity_panel_wide": f"WITH {o.ENTITY}, {o.DENSE} SELECT e.id, village_name, state_name, district_name, {_R('latitude', 'longitude', *_NTL)} FROM entity e LEFT JOIN dense d ON e.id = d.id",
    "growth_signals": f"WITH {o.GROWN} SELECT id, {_R('ntl_growth_pct', 'ntl_growth_log', 'builtup_change', 'ghsl_change')} FROM grown",
    "ols_trend": f"WITH {o.GAPPY} SELECT id, count(value) AS n_years, round(CASE WHEN count(value) >= 3 THEN regr_slope(value, yr) END, 9) AS slope FROM long_gappy GROUP BY id",
    "ols_trend_wide": f"WITH {o.GAPPY} SELECT id, round(CASE WHEN count(value) >= 3 THEN regr_slope(value, yr) END, 9) AS slope FROM long_gappy GROUP BY id",
    "changepoint": f"{changepoint_sql()} SELECT d.id, yr AS ntl_breakpoint_year, round(sa, 8) AS ntl_pre_slope, round(sb, 8) AS ntl_post_slope, round(sb - sa, 8) AS ntl_acceleration FROM dense d LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON d.id = b.id",
    "pct_rank_nulls_bottom": f"WITH {o.PANEL} SELECT id, round(ghsl_change, 6) AS ghsl_change, round({o.pct_rank('ghsl_change')}, 6) AS pct FROM panel",
    "minmax_score": f"WITH {o.GROWN} SELECT id, round({o.minmax('ntl_growth_log', 'grown')}, 6) AS ntl_growth_log_score, round({o.minmax('ghsl_change', 'grown')}, 6) AS ghsl_change_score, 0.0::DOUBLE AS missing_score, round((1 + (count(*) OVER () - 1) / 2.0) / count(*) OVER () * 100.0, 6) AS flat_score FROM grown",
    "zscore_by_state": f"WITH {o.PANEL} SELECT id, state_name, round({o.zscore('ghsl_change', 'state_name')}, 6) AS ghsl_change_z FROM panel",
    "track_split": f"WITH {o.GROWN} SELECT id, CASE WHEN is_main THEN 'main' ELSE 'dark' END AS track FROM grown",
    "left_join_optional": f"WITH {o.ENTITY}, {o.CHANGES} SELECT e.id, village_name, {_R('ghsl_2015', 'ghsl_2020')} FROM entity e LEFT JOIN ghsl g ON e.id = g.id",
    "full_outer_builtup": f"WITH {o.CHANGES} SELECT id, {_R('built_2020', 'built_2021', 'builtup_change')} FROM built",
    "semi_shortlist": f"WITH {o.SCORED}, {o.TOP} SELECT id, village_name, state_name, district_name FROM entity WHERE id IN (SELECT id FROM top)",
    "anti_losers": f"WITH {o.SCORED}, {o.TOP} SELECT id, village_name, state_name, district_name FROM entity WHERE id NOT IN (SELECT id FROM top)",
    "indicator_join": f"WITH {o.SCORED}, {o.TOP}, k AS (SELECT DISTINCT {_KEY.format('district_name')} AS district_key FROM entity), t AS (SELECT DISTINCT {_KEY.format('district_name')} AS district_key FROM top) SELECT k.district_key, CASE WHEN t.district_key IS NULL THEN 'left_only' ELSE 'both' END AS found FROM k LEFT JOIN t ON k.district_key = t.district_key",
    "composite_redistribute": f"WITH {o.SCORED} SELECT id, {_R('ntl_growth_log_score', 'ghsl_change_score', 'composite_score')} FROM scored",
    "votes_confirmed": f"WITH {o.SCORED}, v AS (SELECT id, coalesce((ntl_growth_pct > 50)::INT, 0) + coalesce((builtup_change > 0)::INT, 0) + coalesce((ghsl_change > 0)::INT, 0) AS votes FROM scored) SELECT id, votes, votes >= 2 AS multi_signal_confirmed FROM v",
    "uncertainty": f"""WITH {o.GROWN}, m AS (SELECT *, NULL::DOUBLE AS s1 FROM grown WHERE is_main), r AS (SELECT id, {o.pct_rank('ntl_growth_pct')} AS a, {o.pct_rank('builtup_change')} AS b, {o.pct_rank('ghsl_change')} AS c, {o.pct_rank('s1')} AS d FROM m),
        n AS (SELECT (coalesce(stddev_samp(ntl_growth_pct), 0) > 1e-9)::INT + (coalesce(stddev_samp(builtup_change), 0) > 1e-9)::INT + (coalesce(stddev_samp(ghsl_change), 0) > 1e-9)::INT AS k FROM m)
        SELECT id, round(k / 4.0 * 100, 1) AS confidence_score, k AS signals_active, 4 AS signals_attempted, round(greatest(0, least(1, 1 - sqrt((pow(a - e, 2) + pow(b - e, 2) + pow(c - e, 2) + pow(d - e, 2)) / 3) / 50)) * 100, 1) AS inter_signal_agreement FROM (SELECT *, (a + b + c + d) / 4 AS e FROM r) CROSS JOIN n""",
    "district_rank": f"WITH {o.SCORED}, s AS (SELECT *, round(composite_score, 9) AS cs FROM scored) SELECT id, district_name, round({o.pct_rank('cs', 'district_name')}, 6) AS district_rank_pct FROM s",
    "state_cap_topn": f"WITH {o.SCORED}, {o.TOP} SELECT row_number() OVER (ORDER BY {o.ORDER}) AS rank, id, village_name, state_name, district_name, {_R('composite_score', 'ntl_2019', 'ntl_2024', 'ntl_growth_pct')} FROM top",
    "state_cap_tight": f"WITH {o.SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY state_name ORDER BY {o.ORDER}) AS place FROM scored), t AS (SELECT * FROM p WHERE place <= 2 ORDER BY {o.ORDER} LIMIT 50) SELECT row_number() OVER (ORDER BY {o.ORDER}) AS rank, id, state_name, round(composite_score, 6) AS composite_score FROM t",
    "dark_track": f"WITH {o.GROWN}, {o.DARK}, t AS (SELECT * FROM dark ORDER BY {o.ORDER} LIMIT 50) SELECT row_number() OVER (ORDER BY {o.ORDER}) AS rank, id, round(composite_score, 6) AS composite_score FROM t",
    "union_scored": f"WITH {o.SCORED}, {o.DARK} SELECT id, {_R('ntl_growth_pct', 'ghsl_change_score', 'composite_score')}, 'main' AS track FROM scored UNION ALL SELECT id, NULL, NULL, round(composite_score, 6), 'dark' FROM dark",
    "linear_forecast": f"WITH {o.GAPPY}, {_LIN_CTE} SELECT id, {', '.join(f'round({_LIN(h)}, 4) AS ntl_linear_{2024 + h}' for h in (1, 2, 3))} FROM lin",
    "holt_damped_forecast": f"WITH {_interpolated()} SELECT id, {', '.join(f'round({_HW(h)}, 4) AS ntl_hw_{2024 + h}' for h in (1, 2, 3))} FROM h5",
    "ensemble": f"WITH {_interpolated()}, {_LIN_CTE}, f AS (SELECT h5.id, {', '.join(f'{_LIN(h)} AS a{h}, {_HW(h)} AS b{h}' for h in (1, 2, 3))} FROM h5 JOIN lin ON h5.id = lin.id) SELECT id, {', '.join(f'round(coalesce((a{h} + b{h}) / 2, a{h}, b{h}), 4) AS ntl_forecast_{2024 + h}' for h in (1, 2, 3))} FROM f",
    "rising_stars": f"""WITH {o.SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY {o.ORDER}) AS rank, {o.slope()} AS ntl_trend_slope FROM scored), h AS (SELECT min(composite_score) AS hundredth FROM r WHERE rank <= 100),
        s AS (SELECT *, {o.pct_rank('ntl_trend_slope')} AS pct FROM r WHERE rank BETWEEN 100 AND 2000), l AS (SELECT *, composite_score + pct / 100 * 20 AS projected_score_2027 FROM s CROSS JOIN h)
        SELECT id, rank, round(ntl_trend_slope, 6) AS ntl_trend_slope, round(projected_score_2027, 6) AS projected_score_2027, projected_score_2027 > hundredth AS likely_top100_2027 FROM l ORDER BY round(l.ntl_trend_slope, 9) DESC, id LIMIT 50""",
    "archetype_rules": f"""{changepoint_sql()}, {o.SCORED.replace(o.DENSE + ', ', '')}, s AS (SELECT q.*, b.yr AS bp, b.sb - b.sa AS acc, (q.id % 120)::DOUBLE AS city FROM scored q LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON q.id = b.id)
        SELECT id, CASE WHEN coalesce(acc, 0) > 3.5 AND coalesce(bp, 0) >= 2022 THEN 'NTL Breakout' WHEN coalesce(builtup_change, 0) > 0 AND ghsl_change > 0 THEN 'Construction Boom'
        WHEN ntl_2024 > 10 AND (coalesce(builtup_change, 0) > 0 OR ghsl_change > 200) THEN 'Urban Fringe Surge' WHEN coalesce(ntl_growth_pct, 0) > 80 AND coalesce(builtup_change, 0) <= 0 AND ghsl_change <= 0 THEN 'Rural Electrification'
        WHEN city < 35 THEN 'Urban Fringe Expansion' WHEN city > 90 THEN 'Remote Village Emergence' ELSE 'Steady Grower' END AS archetype_name FROM s""",
    "groundtruth_classify": f"""WITH {o.GROWN}, {_ACCESS}, j AS (SELECT g.id, access, ntl_growth_pct AS g FROM grown g LEFT JOIN acc ON acc.key = {_KEY.format('state_name')})
        SELECT id, round(access, 6) AS access, CASE WHEN access IS NULL THEN 'unknown — SECC join failed' WHEN g IS NULL THEN 'unknown — NTL growth missing'
        WHEN access < 30 AND g > 100 THEN 'high-confidence: low-access block, large NTL rise' WHEN access < 30 AND g > 30 THEN 'moderate-confidence: low-access block, moderate NTL rise' WHEN access < 30 THEN 'low-growth despite low-access block — needs field check'
        WHEN access < 60 AND g > 200 THEN 'high-confidence: partial-access block, large NTL rise' WHEN access < 60 THEN 'medium-access block — economic growth likely contributor'
        WHEN g > 300 THEN 'high-access block — growth likely economic not electrification' ELSE 'high-access block, modest NTL growth — further investigation needed' END AS category FROM j""",
    "per_state_topk": f"WITH {o.SCORED}, p AS (SELECT *, row_number() OVER (PARTITION BY state_name ORDER BY {o.ORDER}) AS place FROM scored) SELECT state_name, place, id, round(composite_score, 6) AS composite_score FROM p WHERE place <= 3",
}
