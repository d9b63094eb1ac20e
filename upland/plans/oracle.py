"""SQL fixtures shared by the oracles: the same derivation as upland.sources.panel, as common table expressions."""

from __future__ import annotations

YEARS = range(2019, 2025)

ENTITY = """entity AS (SELECT p_partkey AS id, p_name AS village_name, p_brand AS state_name, p_brand || '-' || p_type AS district_name,
  8.0::DOUBLE + (p_partkey * 7919 % 29500) / 1000.0 AS latitude, 68.0::DOUBLE + (p_partkey * 104729 % 29500) / 1000.0 AS longitude FROM part)"""
TOWERS = "towers AS (SELECT s_suppkey AS tower_id, 8.0::DOUBLE + (s_suppkey * 6007 % 29500) / 1000.0 AS latitude, 68.0::DOUBLE + (s_suppkey * 15013 % 29500) / 1000.0 AS longitude FROM supplier)"
CITIES = "cities AS (SELECT c_custkey AS city_id, 8.0::DOUBLE + (c_custkey * 4517 % 29500) / 1000.0 AS latitude, 68.0::DOUBLE + (c_custkey * 27011 % 29500) / 1000.0 AS longitude FROM customer WHERE c_acctbal >= 9000)"
_SPREAD = ", ".join(f"max(CASE WHEN yr = {y} THEN value END) AS ntl_{y}" for y in YEARS)
DENSE = f"""long_dense AS (SELECT l_partkey AS id, year(l_shipdate) + 24 AS yr, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 1e6 AS value FROM lineitem
  WHERE year(l_shipdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2), dense AS (SELECT id, {_SPREAD} FROM long_dense GROUP BY id)"""
GAPPY = f"""long_gappy AS (SELECT o_custkey AS id, year(o_orderdate) + 24 AS yr, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 1e7 AS value FROM orders
  WHERE year(o_orderdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2), gappy AS (SELECT id, {_SPREAD} FROM long_gappy GROUP BY id)"""
CHANGES = """b20 AS (SELECT l_partkey AS id, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS built_2020 FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1),
  b21 AS (SELECT l_partkey AS id, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS built_2021 FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1),
  built AS (SELECT coalesce(b20.id, b21.id) AS id, built_2020, built_2021, built_2021 - built_2020 AS builtup_change FROM b20 FULL JOIN b21 ON b20.id = b21.id),
  ghsl AS (SELECT l_partkey AS id, sum(CASE WHEN year(l_shipdate) = 1995 THEN l_quantity END) AS ghsl_2015, sum(CASE WHEN year(l_shipdate) = 2000 THEN l_quantity END) AS ghsl_2020
    FROM lineitem WHERE l_linestatus = 'O' AND year(l_shipdate) IN (1995, 2000) GROUP BY 1)"""
POPULATION = """population AS (SELECT *, CASE WHEN pop_2019 > 0 THEN (pop_2020 - pop_2019) / pop_2019 END AS pop_growth_rate FROM (SELECT l_partkey AS id,
  sum(CASE WHEN year(l_shipdate) = 1996 THEN l_quantity END) AS pop_2019, sum(CASE WHEN year(l_shipdate) = 1997 THEN l_quantity END) AS pop_2020
  FROM lineitem WHERE year(l_shipdate) IN (1996, 1997) GROUP BY 1))"""
_INDEXED = ", ".join(f"max(CASE WHEN yr = {y} THEN {s} END) AS {s}_{y}" for s in ("ndbi", "ndvi") for y in YEARS)
INDICES = f"""yearly AS (SELECT l_partkey AS id, year(l_shipdate) + 24 AS yr, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) / 100.0::DOUBLE AS ndbi,
  sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) / 100.0::DOUBLE AS ndvi FROM lineitem WHERE year(l_shipdate) BETWEEN 1995 AND 2000 GROUP BY 1, 2),
  indices AS (SELECT id, {_INDEXED} FROM yearly GROUP BY id)"""
PANEL = f"""{ENTITY}, {DENSE}, {CHANGES}, panel AS (SELECT e.*, d.* EXCLUDE (id), b.* EXCLUDE (id), g.* EXCLUDE (id), ghsl_2020 - ghsl_2015 AS ghsl_change
  FROM entity e LEFT JOIN dense d ON e.id = d.id LEFT JOIN built b ON e.id = b.id LEFT JOIN ghsl g ON e.id = g.id)"""
PCT = "CASE WHEN ntl_2019 > 0 THEN (ntl_2024 - ntl_2019) / ntl_2019 * 100.0 END"
GROWN = f"""{PANEL}, grown AS (SELECT *, {PCT} AS ntl_growth_pct, ln(1 + CASE WHEN {PCT} > 0 THEN {PCT} WHEN {PCT} IS NOT NULL THEN 0 END) AS ntl_growth_log,
  coalesce(ntl_2019 >= 0.1 AND ntl_2024 - ntl_2019 >= 1.0, false) AS is_main FROM panel)"""


def pct_rank(column: str, over: str = "") -> str:
    part = f"PARTITION BY {over}" if over else ""
    both = f"PARTITION BY {over}, {column}" if over else f"PARTITION BY {column}"
    return f"(rank() OVER ({part} ORDER BY {column} NULLS LAST) + (count(*) OVER ({both}) - 1) / 2.0) / count(*) OVER ({part}) * 100.0"


def minmax(column: str, table: str) -> str:
    lo, hi = f"(SELECT quantile_cont({column}, 0.02) FROM {table})", f"(SELECT quantile_cont({column}, 0.99) FROM {table})"
    return f"coalesce(CASE WHEN {lo} IS NULL THEN 0 WHEN {hi} <= {lo} THEN {pct_rank(column)} ELSE (CASE WHEN {column} < {lo} THEN {lo} WHEN {column} > {hi} THEN {hi} ELSE {column} END - {lo}) / ({hi} - {lo}) * 100.0 END, 0)"


def zscore(column: str, key: str) -> str:
    w = f"OVER (PARTITION BY {key})"
    return f"CASE WHEN {key} IS NULL THEN 0 ELSE coalesce(({column} - avg({column}) {w}) / CASE WHEN count({column}) {w} < 3 THEN 1 ELSE greatest(coalesce(stddev_samp({column}) {w}, 1), 1e-6) END, 0) END"


SCORED_AFTER_GROWN = f"""main0 AS (SELECT * REPLACE ({zscore("ghsl_change", "state_name")} AS ghsl_change) FROM grown WHERE is_main),
  main1 AS (SELECT *, {minmax("ntl_growth_log", "main0")} AS ntl_growth_log_score, {minmax("ghsl_change", "main0")} AS ghsl_change_score FROM main0),
  scored AS (SELECT *, ntl_growth_log_score * (0.30::DOUBLE / 0.45::DOUBLE) + ghsl_change_score * (0.15::DOUBLE / 0.45::DOUBLE) AS composite_score FROM main1)"""
SCORED = f"{GROWN}, {SCORED_AFTER_GROWN}"
DARK = f"""dark0 AS (SELECT * FROM grown WHERE NOT is_main), dark1 AS (SELECT *, {minmax("ntl_growth_log", "dark0")} AS ntl_growth_log_score, {minmax("ghsl_change", "dark0")} AS ghsl_change_score FROM dark0),
  dark AS (SELECT *, ntl_growth_log_score * (0.40::DOUBLE / 0.70::DOUBLE) + ghsl_change_score * (0.30::DOUBLE / 0.70::DOUBLE) AS composite_score FROM dark1)"""
ORDER = "round(composite_score, 9) DESC, id"
TOP = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY state_name ORDER BY {ORDER}) AS place FROM scored), top AS (SELECT * EXCLUDE (place) FROM placed WHERE place <= 40 ORDER BY {ORDER} LIMIT 100)"""
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
D2 = "((a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude))"


def slope(prefix: str = "ntl_", least: int = 3) -> str:
    """Closed-form least-squares sums over the year columns of the current row."""
    there = [f"(CASE WHEN {prefix}{y} IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)" for y in YEARS]
    value = [f"coalesce({prefix}{y}, 0.0::DOUBLE)" for y in YEARS]
    x = [y - YEARS[0] for y in YEARS]
    join = lambda parts: "(" + " + ".join(parts) + ")"
    n, sx, sy = join(there), join([f"{t} * {k}" for t, k in zip(there, x, strict=True)]), join(value)
    sxx, sxy = join([f"{t} * {k * k}" for t, k in zip(there, x, strict=True)]), join([f"{v} * {k}" for v, k in zip(value, x, strict=True)])
    return f"CASE WHEN {n} >= {least} AND {n} * {sxx} - {sx} * {sx} <> 0 THEN ({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}) END"
