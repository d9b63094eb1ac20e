"""Geometry as well-known binary, and GeoPackage layers held as binary files.

A GeoPackage is an SQLite file; each is opened in a worker's memory from its bytes, so no local file is made. A
blob of a layer's geometry column is a short header and well-known binary.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Geometry types, and the header of a layer's blob without an envelope in WGS 84 (fixed values).
POINT, POLYGON = 1, 3
HEADER = b"GP\x00\x01" + struct.pack("<i", 4326)
#: Bytes that envelopes of each kind add to the header (fixed values).
ENVELOPE = (0, 32, 48, 48, 64)


def point_bytes(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, x, y)


def polygon_bytes(rings: list[list[tuple[float, float]]]) -> bytes:
    out = struct.pack("<BII", 1, POLYGON, len(rings))
    for ring in rings:
        out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    return out


def rings_of(raw: bytes | None) -> list[list[tuple[float, float]]] | None:
    """The rings of a polygon, or a point as one ring of one place; other geometries are null."""
    if raw is None:
        return None
    if raw[:2] == b"GP":
        raw = raw[8 + ENVELOPE[raw[3] >> 1 & 7] :]
    order = "<" if raw[0] == 1 else ">"
    kind = struct.unpack_from(f"{order}I", raw, 1)[0]
    if kind == POINT:
        return [[struct.unpack_from(f"{order}dd", raw, 5)]]
    if kind != POLYGON:
        return None
    out, at = [], 9
    for _ in range(struct.unpack_from(f"{order}I", raw, 5)[0]):
        n = struct.unpack_from(f"{order}I", raw, at)[0]
        flat = struct.unpack_from(f"{order}{2 * n}d", raw, at + 4)
        out.append(list(zip(flat[::2], flat[1::2], strict=True)))
        at += 4 + 16 * n
    return out


def to_wkb(x: Column, y: Column) -> Column:
    """Points as well-known binary."""

    @F.arrow_udf("binary")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        both = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([None if a is None or b is None else point_bytes(a, b) for a, b in both], pa.binary())

    return run(x, y)


def from_wkb(raw: Column) -> Column:
    """array<array<struct<x, y>>>: the rings of polygons; a point is one ring of one place."""

    @F.arrow_udf("array<array<struct<x:double,y:double>>>")
    def run(raw: pa.Array) -> pa.Array:
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        found = [rings_of(r) for r in raw.to_pylist()]
        return pa.array([f and [[{"x": x, "y": y} for x, y in ring] for ring in f] for f in found], kind)

    return run(raw)


def package(layer: str, rows: pd.DataFrame, geometry: list[bytes]) -> bytes:
    """The bytes of a GeoPackage with one layer."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, srs_id INTEGER)")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER)")
    con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', 4326)", (layer,))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', 4326)", (layer,))
    names = ", ".join(f'"{c}"' for c in rows.columns)
    con.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, {names})')
    places = ", ".join("?" * (1 + len(rows.columns)))
    values = ((HEADER + g, *map(_plain, r)) for g, r in zip(geometry, rows.itertuples(index=False), strict=True))
    con.executemany(f'INSERT INTO "{layer}" (geom, {names}) VALUES ({places})', values)
    con.commit()
    return con.serialize()


def _plain(v):
    return v.item() if hasattr(v, "item") else v


def write_packages(points: DataFrame, group: str, layer: str) -> DataFrame:
    """path and content of a GeoPackage for each value of `group`; points have longitude and latitude."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shapes = [point_bytes(x, y) for x, y in zip(rows["longitude"], rows["latitude"], strict=True)]
        body = package(layer, rows.drop(columns=["longitude", "latitude"]), shapes)
        return pd.DataFrame({"path": [f"{rows[group].iloc[0]}.gpkg"], "content": [body]})

    return points.groupBy(group).applyInPandas(run, "path string, content binary")


def read_layer(packages: DataFrame, layer: str, columns: dict[str, str], batch: int = 10_000) -> DataFrame:
    """The wanted columns, by name and type, and the rings of a layer, from files loaded as `binaryFile`.

    Files without the layer give no rows; columns that a file lacks are null. Other columns aren't read."""
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for content in files["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(content)
                there = [r[1] for r in con.execute(f'PRAGMA table_info("{layer}")')]
                if not there:
                    continue
                own = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                wanted = ", ".join(f'"{c}"' if c in there else f'NULL AS "{c}"' for c in columns)
                found = con.execute(f'SELECT {wanted}, "{own[0] if own else "geom"}" AS wkb FROM "{layer}"')
                while rows := found.fetchmany(batch):
                    yield pd.DataFrame(rows, columns=[*columns, "wkb"])

    rows = packages.select("content").mapInPandas(run, f"{schema}, wkb binary")
    return rows.select(*columns, from_wkb(F.col("wkb")).alias("rings"))
