"""The whole scoring run: all signals, scores, lag, votes, uncertainty, duplicates, caps, both tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.functions import ranks, series
from upland.operators import ml, scoring, spatial
from upland.plans import oracle as o
from upland.plans.features import changepoint_sql, rounded
from upland.plans.intake import highways
from upland.plans.spatial_queries import components_sql, name_key_sql
from upland.sources import panel as src
from upland.sources.store import cut

#: Signals that are scored, in the order in which the amplifier's label counts them (fixed values).
SIGNALS = [
    "ntl_growth_log", "ntl_trend_slope", "ntl_2024", "ndbi_growth", "ndbi_trend_slope", "ndvi_trend_slope", "ghsl_change",
    "s1_vv_delta", "tower_growth", "pop_growth_rate", "builtup_change", "ntl_acceleration", "dist_city_km", "dist_highway_km",
]
#: Signals of the dark track (fixed values).
DARK = ["ndbi_growth", "ghsl_change", "tower_growth", "pop_growth_rate"]
#: Towers then as a share of towers now, the radius they are counted in, and the radius within which one name is one place.
TOWERS_THEN, TOWER_DEGREES, SAME_PLACE_KM = 0.6, 1.5, 100.0


def with_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with every signal, each from a table of its own, merged by id; there is no radar, so its delta is null."""
    rows = src.panel(spark, sf_dir)
    stand_in = F.concat(F.lit("Village_"), F.col("id").cast("string"))
    rows = rows.withColumn("village_name", F.when(F.col("id") % 7 == 0, stand_in).otherwise(F.col("village_name")))
    points = cut(rows.select("id", "latitude", "longitude"), "points")
    counted = spatial.radius_count(points, src.towers(spark, sf_dir), TOWER_DEGREES, "towers").select("id", "towers")
    city = spatial.planar_nearest_km(points, src.cities(spark, sf_dir).withColumnRenamed("city_id", "other_id"))
    road = spatial.planar_nearest_km(points, highways(spark, sf_dir))
    for table in (
        src.index_panel(spark, sf_dir),
        src.population(spark, sf_dir),
        counted,
        city.select("id", F.round("km", 9).alias("dist_city_km")),
        road.select("id", F.round("km", 9).alias("dist_highway_km")),
    ):
        rows = rows.join(table, "id", "left")
    rows = scoring.with_deltas(scoring.with_growth(rows)).withColumn("c", series.changepoint())
    own = {f"{s}_trend_slope": F.round(series.trend([f"{s}_{y}" for y in src.YEARS])[0], 9) for s in ("ntl", "ndbi", "ndvi")}
    own |= {
        "ndbi_growth": F.round("ndbi_growth", 9),
        "ntl_acceleration": F.round(F.col("c.post") - F.col("c.pre"), 8),
        "tower_growth": F.round(F.col("towers") * (1 - TOWERS_THEN), 9),
    }
    return cut(rows.withColumns(own).drop("c"), "signals")


def scored_main(rows: DataFrame, amplifier: bool = False) -> DataFrame:
    """The main track, ranked, one entity of a name within SAME_PLACE_KM."""
    main = ranks.with_zscore(rows.filter(scoring.is_main()), "ghsl_change", "state_name", "ghsl_change")
    main = cut(main.withColumn("ghsl_change", F.round("ghsl_change", 9)), "main-track")
    scores = {s: f"{s}_score" for s in SIGNALS}
    if amplifier:
        main = cut(ml.amplify(main, SIGNALS).withColumn("ml_growth_prob", F.coalesce("ml_growth_prob", F.lit(0.0))), "amplified")
        main = ranks.with_minmax_scores(main, {"ml_growth_prob": "ml_growth_prob_score"}, 0.0, 1.0)
    main = cut(ranks.with_minmax_scores(main, scores), "scores")
    lag = spatial.spatial_lag(main.select("id", "latitude", "longitude", "ntl_growth_log_score"), "ntl_growth_log_score", 10)
    main = main.join(lag.withColumnRenamed("spatial_lag", "spatial_lag_score"), "id", "left")
    main = main.withColumn("composite_score", scoring.composite(main.columns))
    main = main.withColumn("multi_signal_confirmed", scoring.votes(main.columns) >= 2)
    main = ranks.with_pct_rank_within(main, F.round("composite_score", 9), ["district_name"], "district_rank_pct")
    main = cut(scoring.uncertainty(main, SIGNALS), "scored")
    return scoring.ranked_whole(one_of_a_name(main))


def one_of_a_name(rows: DataFrame) -> DataFrame:
    """Of entities with one base name near one another, the best."""
    linked = spatial.named_links(rows, scoring.base_name(F.col("village_name")), SAME_PLACE_KM)
    return scoring.keep_best_linked(rows, *linked, scoring.order_of())


def preferred() -> list[Column]:
    """Named entities before others of nearly the same score."""
    bonus = F.when(scoring.unnamed(F.col("village_name")), 0.0).otherwise(0.001)
    return [F.round(F.col("composite_score") + bonus, 9).desc(), F.col("id").asc()]


def shortlist(main: DataFrame, n: int = 100, share: float = 0.40) -> DataFrame:
    """The capped best, once more without duplicates, ranked anew."""
    top = cut(scoring.capped(main.drop("rank"), n, share, order=preferred()), "shortlist")
    return scoring.ranked(one_of_a_name(top))


OUT = ["rank", "id", "village_name", "state_name", "composite_score", "multi_signal_confirmed", "district_rank_pct", "confidence_score", "inter_signal_agreement"]


def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlist of the whole run without the learned amplifier, whose weight goes to the other scores."""
    return rounded(shortlist(scored_main(with_signals(spark, sf_dir))).select(*OUT), "composite_score", "district_rank_pct", places=5)


def full_run_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tracks, each with ranks of its own."""
    rows = with_signals(spark, sf_dir)
    main = scored_main(rows).select("id", "rank", "composite_score", F.lit("main").alias("track"))
    dark = cut(rows.filter(~scoring.is_main()), "dark-track")
    dark = ranks.with_minmax_scores(dark, {s: f"{s}_score" for s in DARK})
    weights = scoring.redistribute(scoring.DARK_WEIGHTS, dark.columns)
    dark = dark.withColumn("composite_score", series.total([F.col(c) * w for c, w in weights.items()]))
    dark = scoring.ranked_whole(dark).select("id", "rank", "composite_score", F.lit("dark").alias("track"))
    return rounded(main.unionByName(dark), "composite_score", places=5)


def full_run_amplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlist of the whole run, amplifier included; its probabilities are the engine's own."""
    return rounded(shortlist(scored_main(with_signals(spark, sf_dir), amplifier=True)).select(*OUT), "composite_score", "district_rank_pct")


QUERIES = {f.__name__: f for f in (full_run, full_run_scored, full_run_amplified)}


def _km(table: str) -> str:
    return f"round((SELECT min(sqrt(pow(e.latitude - b.latitude, 2) + pow((e.longitude - b.longitude) * c, 2))) * 111.0 FROM {table} b), 9)"


def signals_sql() -> str:
    """The table of all signals, as common table expressions from the dense panel on."""
    near = o.D2.replace("a.", "e.")
    return f"""{changepoint_sql().removeprefix("WITH ")}, {o.GROWN.replace(o.DENSE + ", ", "")}, {o.POPULATION}, {o.INDICES}, {o.TOWERS}, {o.CITIES},
      road AS (SELECT * FROM towers WHERE tower_id % 5 = 0), middle AS (SELECT cos(radians(avg(latitude))) AS c FROM entity),
      signals AS (SELECT e.* REPLACE (CASE WHEN e.id % 7 = 0 THEN 'Village_' || e.id::VARCHAR ELSE village_name END AS village_name),
        round({o.slope()}, 9) AS ntl_trend_slope, round(ndbi_2024 - ndbi_2019, 9) AS ndbi_growth, round({o.slope("ndbi_")}, 9) AS ndbi_trend_slope,
        round({o.slope("ndvi_")}, 9) AS ndvi_trend_slope, NULL::DOUBLE AS s1_vv_delta, pop_growth_rate, round(sb - sa, 8) AS ntl_acceleration,
        round((SELECT count(*) FROM towers b WHERE {near} <= {TOWER_DEGREES**2}) * (1 - {TOWERS_THEN}::DOUBLE), 9) AS tower_growth,
        {_km("cities")} AS dist_city_km, {_km("road")} AS dist_highway_km
        FROM grown e CROSS JOIN middle LEFT JOIN indices i ON e.id = i.id LEFT JOIN population p ON e.id = p.id LEFT JOIN (SELECT * FROM best WHERE rn = 1) k ON e.id = k.id)"""


def _one_of_a_name_sql(rows: str, out: str) -> str:
    """A table without duplicates, by the components of its pairs."""
    return f"""{out}_n AS (SELECT *, {name_key_sql()} AS base FROM {rows}),
      {out}_pairs AS (SELECT a.id AS a, b.id AS b FROM {out}_n a JOIN {out}_n b ON a.base = b.base AND a.id < b.id WHERE a.base <> '' AND {o.HAVERSINE} <= {SAME_PLACE_KM}),
      {components_sql(out)}, {out}_placed AS (SELECT n.id, row_number() OVER (PARTITION BY component ORDER BY round(composite_score, 9) DESC, n.id) AS place FROM {out}_n n JOIN {out}_comp c ON n.id = c.id),
      {out} AS (SELECT * EXCLUDE (base) FROM {out}_n WHERE id NOT IN (SELECT id FROM {out}_placed WHERE place > 1))"""


def _main_sql() -> str:
    scores = ", ".join(f"{o.minmax(s, 'main0')} AS {s}_score" for s in SIGNALS)
    weights = scoring.redistribute(scoring.WEIGHTS, [f"{s}_score" for s in SIGNALS] + ["spatial_lag_score"])
    composite = " + ".join(f"{c} * {w!r}::DOUBLE" for c, w in weights.items())
    votes = " + ".join(f"coalesce(({c} > {v})::INT, 0)" for c, v in scoring.VOTES.items())
    pct = ", ".join(f"{o.pct_rank(s)} AS {s}" for s in SIGNALS)
    active = " + ".join(f"(coalesce(stddev_samp({s}), 0) > 1e-9)::INT" for s in SIGNALS)
    n = len(SIGNALS)
    spread = " + ".join(f"pow({s} - ({' + '.join(SIGNALS)}) / {n}, 2)" for s in SIGNALS)
    return f"""{signals_sql()},
      main0 AS (SELECT * REPLACE (round({o.zscore("ghsl_change", "state_name")}, 9) AS ghsl_change) FROM signals WHERE is_main),
      main1 AS (SELECT *, {scores} FROM main0),
      near AS (SELECT a.id, b.ntl_growth_log_score AS v, row_number() OVER (PARTITION BY a.id ORDER BY {o.D2}, b.id) AS rn FROM main1 a JOIN main1 b ON a.id <> b.id),
      lag AS (SELECT id, avg(v) AS spatial_lag_score FROM near WHERE rn <= 10 GROUP BY id),
      main2 AS (SELECT main1.*, spatial_lag_score FROM main1 LEFT JOIN lag ON main1.id = lag.id),
      main3 AS (SELECT *, {composite} AS composite_score, {votes} >= 2 AS multi_signal_confirmed FROM main2),
      main4 AS (SELECT *, round(composite_score, 9) AS cs FROM main3),
      main5 AS (SELECT *, {o.pct_rank("cs", "district_name")} AS district_rank_pct FROM main4),
      pct AS (SELECT id, {pct} FROM main0), act AS (SELECT {active} AS k FROM main0),
      unc AS (SELECT id, round(k / {float(n)} * 100, 1) AS confidence_score, round(greatest(0, least(1, 1 - sqrt(({spread}) / {n - 1}) / 50)) * 100, 1) AS inter_signal_agreement FROM pct CROSS JOIN act),
      main6 AS (SELECT main5.*, confidence_score, inter_signal_agreement FROM main5 JOIN unc ON main5.id = unc.id),
      {_one_of_a_name_sql("main6", "main7")},
      main AS (SELECT *, row_number() OVER (ORDER BY cs DESC, id) AS main_rank FROM main7)"""


def _full_run_sql() -> str:
    first = "round(composite_score + CASE WHEN coalesce(regexp_matches(village_name, '^Village_\\d+$'), true) THEN 0 ELSE 0.001 END, 9) DESC, id"
    return f"""WITH RECURSIVE {_main_sql()}, placed AS (SELECT *, row_number() OVER (PARTITION BY state_name ORDER BY {first}) AS own_place FROM main),
      best0 AS (SELECT * FROM placed WHERE own_place <= 40 ORDER BY {first} LIMIT 100), {_one_of_a_name_sql("best0", "best1")}
      SELECT row_number() OVER (ORDER BY cs DESC, id) AS rank, id, village_name, state_name, round(composite_score, 5) AS composite_score, multi_signal_confirmed,
        round(district_rank_pct, 5) AS district_rank_pct, confidence_score, inter_signal_agreement FROM best1"""


def _scored_sql() -> str:
    weights = scoring.redistribute(scoring.DARK_WEIGHTS, [f"{s}_score" for s in DARK])
    scores = ", ".join(f"{o.minmax(s, 'dark0')} AS {s}_score" for s in DARK)
    composite = " + ".join(f"{c} * {w!r}::DOUBLE" for c, w in weights.items())
    return f"""WITH RECURSIVE {_main_sql()}, dark0 AS (SELECT * FROM signals WHERE NOT is_main), dark1 AS (SELECT *, {scores} FROM dark0),
      dark AS (SELECT id, {composite} AS composite_score FROM dark1)
      SELECT id, main_rank AS rank, round(composite_score, 5) AS composite_score, 'main' AS track FROM main
      UNION ALL SELECT id, row_number() OVER (ORDER BY round(composite_score, 9) DESC, id), round(composite_score, 5), 'dark' FROM dark"""


ORACLE_SQL = {"full_run": _full_run_sql(), "full_run_scored": _scored_sql()}
