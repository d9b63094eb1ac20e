"""Pixel tiles: zonal sums by row spans over prefix sums, and a layout that reads a window without the rest.

A band is a table of row, col and value, a row for each cell that it has. Its tiles are TILE x TILE cells.

* Zonal sums: a zone becomes spans of columns, those cells of each row whose centres lie in it, dealt to tiles; a tile
  carries sums along its rows, so a span of any length costs two look-ups a tile row. Cells meet no polygon, and what
  is joined are tiles and units of many zones' spans.
* Windows: tiles are written in the order of a Z curve, so tiles that lie together share row groups; a window is a few
  runs of the curve, and the filter on them skips the other row groups by their statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

TILE = 64
#: Runs of the curve that a window's filter names at most; spans that a task makes at once.
RUNS, SPANS = 16, 1 << 18
SUMMED = "tile_r long, tile_c long, sums array<double>, cells array<int>, hits array<int>"
SPAN = "tile_r long, tile_c long, r array<int>, a array<int>, b array<int>"


def summed_tiles(band: DataFrame, nodata: float, klass: float, size: int = TILE) -> DataFrame:
    """Tiles with the values, the cells that have one and the cells of `klass` before each column of each row."""
    at = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int")
    tile = [F.floor(F.col(c) / size).cast("long").alias(f"tile_{c[0]}") for c in ("row", "col")]
    cells = band.filter((F.col("value") != nodata) & ~F.isnan("value")).select(*tile, at.alias("at"), F.col("value").cast("double").alias("value"))
    packed = cells.groupBy("tile_r", "tile_c").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))  # size * size at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for at, value in zip(batch.column("at"), batch.column("value"), strict=True):
                at, value = at.values.to_numpy(), value.values.to_numpy()
                for k, v in enumerate((value, np.ones(len(at)), value == klass)):
                    whole = np.bincount(at, v, size * size).reshape(size, size)
                    out[k].append(np.pad(whole.cumsum(1), ((0, 0), (1, 0))).ravel())
            lists = [pa.array(x, pa.list_(t)) for x, t in zip((out[0], *[[v.astype(np.int32) for v in x] for x in out[1:]]), (pa.float64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tile_r"), batch.column("tile_c"), *lists], names=["tile_r", "tile_c", "sums", "cells", "hits"])

    return packed.mapInArrow(run, SUMMED)


def filled_tiles(cells: DataFrame, size: int = TILE) -> DataFrame:
    """tile_r, tile_c and the pixels of each tile, row by row; `cells` has row, col and value, a row a cell at most."""
    at = (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int")
    tile = [F.floor(F.col(c) / size).cast("long").alias(f"tile_{c[0]}") for c in ("row", "col")]
    packed = cells.select(*tile, at.alias("at"), F.col("value").cast("double").alias("value")).filter("value is not null")
    packed = packed.groupBy("tile_r", "tile_c").agg(F.collect_list("at").alias("at"), F.collect_list("value").alias("value"))  # size * size at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, gaps = np.zeros((batch.num_rows, size * size)), np.ones((batch.num_rows, size * size), bool)
            for k in range(batch.num_rows):
                own = batch.column("at")[k].values.to_numpy()
                values[k, own], gaps[k, own] = batch.column("value")[k].values.to_numpy(), False
            flat = pa.array(values.ravel(), pa.float64(), mask=gaps.ravel())
            pixels = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * size * size, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("tile_r"), batch.column("tile_c"), pixels], names=["tile_r", "tile_c", "pixels"])

    return packed.mapInArrow(run, "tile_r long, tile_c long, pixels array<double>")


def first_centre(x: np.ndarray, x0: float, step: float) -> np.ndarray:
    """The first column whose centre x0 + (column + 0.5) * step is `x` or beyond, to the last bit."""
    c = np.ceil((x - x0) / step - 0.5)
    c -= x0 + (c - 1 + 0.5) * step >= x
    return (c + (x0 + (c + 0.5) * step < x)).astype(np.int64)


def spans_of(edges: np.ndarray, x0: float, y0: float, step: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, first and last column of the runs of cells whose centres an odd number of edges lies to the right of.

    `edges` are x1, y1, x2, y2. Rows are taken in bands, so the spans of a tall zone are never all at hand."""
    if not len(edges):
        return
    low, high = edges[:, [1, 3]].min(), edges[:, [1, 3]].max()
    first, last = int(np.floor((y0 - high) / step)) - 1, int(np.floor((y0 - low) / step)) + 1
    band = max(1, SPANS // len(edges))
    for r in range(first, last + 1, band):
        row = np.arange(r, min(r + band, last + 1))
        y = y0 - (row + 0.5) * step
        crossed = (edges[:, 1] > y[:, None]) != (edges[:, 3] > y[:, None])
        i, e = np.nonzero(crossed)
        x1, y1, x2, y2 = edges[e].T
        x = (x2 - x1) * (y[i] - y1) / (y2 - y1) + x1
        order = np.lexsort((x, i))
        i, x = i[order], x[order]  # each row has an even number of crossings
        a, b = first_centre(x[::2], x0, step), first_centre(x[1::2], x0, step) - 1
        kept = a <= b
        yield row[i[::2]][kept], a[kept], b[kept]


def _dealt(row: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The spans of each tile that they meet, with rows and columns of the tile."""
    if not len(row):
        return
    tiles = b // size - a // size + 1
    of = np.repeat(np.arange(len(row)), tiles)
    tile = np.arange(len(of)) - np.repeat(np.cumsum(tiles) - tiles, tiles) + (a // size)[of]
    own, left, right = row[of], np.maximum(a[of], tile * size) - tile * size, np.minimum(b[of], tile * size + size - 1) - tile * size + 1
    order = np.lexsort((tile, own // size))
    key = np.stack([own // size, tile])[:, order]
    edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
    for i, j in zip(edge, [*edge[1:], len(order)], strict=True):
        at = order[i:j]
        yield int(key[0, i]), int(key[1, i]), own[at] % size, left[at], right[at]


def zone_spans(zones: DataFrame, x0: float, y0: float, step: float, size: int = TILE) -> DataFrame:
    """id and, for each tile that the zone's edges (x1, y1, x2, y2) meet, its spans; a row a tile and band of rows."""
    rows = zones.select("id", *[F.col(f"edges.{k}").cast("array<double>").alias(k) for k in ("x1", "y1", "x2", "y2")]).filter("x1 is not null")
    schema = StructType([zones.schema["id"], *_fields(zones, SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                edges = np.stack([batch.column(c)[k].values.to_numpy() for c in ("x1", "y1", "x2", "y2")], 1)
                for row, a, b in spans_of(edges, x0, y0, step):
                    yield from _span_batch(batch.column("id").slice(k, 1), _dealt(row, a, b, size), schema.names)

    return rows.mapInArrow(run, schema)


def box_spans(zones: DataFrame, size: int = TILE) -> DataFrame:
    """`zone_spans` of zones that are rows r0 to r1 and columns c0 to c1."""
    rows = zones.select("id", *[F.col(c).cast("long").alias(c) for c in ("r0", "r1", "c0", "c1")]).filter("r0 <= r1 and c0 <= c1")
    tiles = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long")))
    dealt = rows.withColumn("tile_r", tiles("r0", "r1")).withColumn("tile_c", tiles("c0", "c1"))
    row = F.sequence(F.greatest(F.col("r0") - F.col("tile_r") * size, F.lit(0)).cast("int"), F.least(F.col("r1") - F.col("tile_r") * size, F.lit(size - 1)).cast("int"))
    ends = {"a": F.greatest(F.col("c0") - F.col("tile_c") * size, F.lit(0)), "b": F.least(F.col("c1") - F.col("tile_c") * size, F.lit(size - 1)) + 1}
    return dealt.withColumn("r", row).select("id", "tile_r", "tile_c", "r", *[F.array_repeat(e.cast("int"), F.size("r")).alias(c) for c, e in ends.items()])


def _fields(df: DataFrame, ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def _span_batch(own: pa.Array, dealt: Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    found = list(dealt)
    if found:
        lists = [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in (2, 3, 4)]
        tiles = [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([own.take(pa.array(np.zeros(len(found), np.int64))), *tiles, *lists], names=names)


def zonal_sums(spans: DataFrame, tiles: DataFrame, size: int = TILE, unit: int = SPANS) -> DataFrame:
    """id, mean and share of each zone that has a cell: what its spans add up to over the tiles; `spans` is read twice.

    A tile meets its spans in units of about `unit`, so it is sent once for each of these, not once for each zone, and a
    tile that all zones meet is many units. Spans outnumber the table they are made of, so no side's size is guessed."""
    keys = ["tile_r", "tile_c"]
    schema = StructType([spans.schema["id"], *_fields(spans, "total double, n long, k long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, *sums in zip(*(batch.column(c) for c in ("held", "sums", "cells", "hits")), strict=True):
                r, a, b = (held.values.field(c) for c in ("r", "a", "b"))
                n = r.value_lengths().to_numpy()
                row = r.flatten().to_numpy().astype(np.int64) * (size + 1)
                low, high = row + a.flatten().to_numpy(), row + b.flatten().to_numpy()
                first = np.cumsum(n) - n
                found = [np.add.reduceat((v := s.values.to_numpy())[high] - v[low], first) for s in sums]
                columns = [pa.array(x, t) for x, t in zip(found, (pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([held.values.field("id"), *columns], names=schema.names)

    spans = spans.filter(F.size("r") > 0)
    load = spans.groupBy(*keys).agg(F.ceil(F.sum(F.size("r")) / unit).cast("long").alias("units"))
    dealt = spans.hint("merge").join(load, keys).withColumn("unit", F.pmod(F.xxhash64("id"), "units"))
    packed = dealt.groupBy(*keys, "unit").agg(F.collect_list(F.struct("id", "r", "a", "b")).alias("held"))  # about `unit` spans
    parts = packed.hint("merge").join(tiles, keys).select("held", "sums", "cells", "hits").mapInArrow(run, schema)
    added = parts.groupBy("id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("k").alias("k")).filter("n > 0")
    return added.select("id", (F.col("total") / F.col("n")).alias("mean"), (F.col("k") / F.col("n")).alias("share"))


def curve(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of a tile on the Z curve: the bits of row and column in turn. Tiles lie within 31 bits either way of 0."""
    out = np.zeros(len(r), np.int64)
    r, c = r + (1 << 30), c + (1 << 30)
    for bit in range(31):
        out |= ((r >> bit & 1) << (2 * bit + 1)) | ((c >> bit & 1) << (2 * bit))
    return out


def runs_of(r0: int, r1: int, c0: int, c1: int, most: int = RUNS) -> list[tuple[int, int]]:
    """At most `most` runs of the curve that hold all tiles of a window: squares of the curve are halved where the window
    only grazes them, those that would spare most first, until the runs are used up."""
    def square(level: int, r: int, c: int) -> tuple[int, int]:
        first = int(curve(np.array([r]), np.array([c]))[0])
        return first, first + (1 << (2 * level)) - 1

    def kind(level: int, r: int, c: int) -> int:
        """0: apart from the window, 1: meets it, 2: within it."""
        side = (1 << level) - 1
        if r > r1 or r + side < r0 or c > c1 or c + side < c0:
            return 0
        return 2 if r >= r0 and r + side <= r1 and c >= c0 and c + side <= c1 else 1

    open_, done = [(31, -(1 << 30), -(1 << 30))], []
    while open_ and len(open_) + len(done) + 3 <= 4 * most:
        level, r, c = max(open_)
        open_.remove((level, r, c))
        if not level:
            done.append((level, r, c))
            continue
        half = 1 << (level - 1)
        for a, b in ((r, c), (r, c + half), (r + half, c), (r + half, c + half)):
            if k := kind(level - 1, a, b):
                (done if k == 2 else open_).append((level - 1, a, b))
    runs = sorted(square(*x) for x in open_ + done)
    while True:
        gaps = [(b[0] - a[1], i) for i, (a, b) in enumerate(zip(runs, runs[1:], strict=False))]
        if not gaps or (len(runs) <= most and min(gaps)[0] > 1):
            return runs
        _, i = min(gaps)
        runs[i : i + 2] = [(runs[i][0], runs[i + 1][1])]


def write_tiles(tiles: DataFrame, folder: str, files: int | None = None, group_bytes: int = 1 << 20) -> None:
    """Tiles (tile_r, tile_c and what they hold) as Parquet along the curve, in row groups of about `group_bytes`."""
    schema = StructType([*tiles.schema.fields, StructField("z", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = curve(batch.column("tile_r").to_numpy(), batch.column("tile_c").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], names=schema.names)

    placed = tiles.mapInArrow(run, schema)
    ranged = placed.repartitionByRange(files, "z") if files else placed.repartitionByRange("z")
    writer = ranged.sortWithinPartitions("z").write.option("parquet.block.size", group_bytes).option("parquet.block.size.row.check.min", 4)
    writer.option("parquet.page.size.row.check.min", 4).parquet(folder)


def read_window(spark: SparkSession, folder: str, r0: int, r1: int, c0: int, c1: int, size: int = TILE) -> DataFrame:
    """The tiles that hold the cells of rows r0 to r1 and columns c0 to c1."""
    at = [v // size for v in (r0, r1, c0, c1)]
    on_curve = F.lit(False)
    for a, b in runs_of(*at):
        on_curve |= F.col("z").between(a, b)
    tiles = spark.read.parquet(folder).filter(on_curve)
    return tiles.filter(F.col("tile_r").between(at[0], at[1]) & F.col("tile_c").between(at[2], at[3])).drop("z")
