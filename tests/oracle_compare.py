"""Compare a query's rows with its SQL oracle in DuckDB, whatever their order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> tuple[list[str], Counter, Counter]:
    """What is wrong with the columns; rows only in the query; rows only in the oracle."""
    found = con.sql(sql)
    wrong = [] if sorted(df.columns) == sorted(found.columns) else [f"{sorted(df.columns)} against {sorted(found.columns)}"]
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    return wrong, ours - theirs, theirs - ours
