"""Binary grids: a metadata text and a block of 32-bit floats, as satellite tiles come.

The text holds the west and north bounds and the cell size in millionths of a degree, the shape, and the value
that stands for no data; it ends with a line of its own. A file is one tile, so a task holds one tile at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

END = b"END\n"
#: Names of the metadata (fixed values).
FIELDS = ("WestBound", "NorthBound", "CellSize", "Rows", "Columns", "FillValue")
CELLS = "path string, row int, col int, longitude double, latitude double, value double"


def grid_bytes(west: float, north: float, step: float, values: np.ndarray, fill: float) -> bytes:
    """A grid file; NaN becomes the fill value."""
    numbers = (round(west * 1e6), round(north * 1e6), round(step * 1e6), *values.shape, fill)
    text = "".join(f"{k}={v}\n" for k, v in zip(FIELDS, numbers, strict=True))
    return text.encode() + END + np.where(np.isnan(values), fill, values).astype("<f4").tobytes()


def metadata(content: bytes) -> tuple[dict[str, float], int]:
    """The numbers of a grid file's text, and where the cells begin."""
    end = content.index(END)
    text = content[:end].decode()
    found = {k: re.search(rf"{k}\s*=\s*(-?[0-9.]+)", text) for k in FIELDS}
    lacking = [k for k, v in found.items() if v is None]
    if lacking:
        raise ValueError(f"grid without {', '.join(lacking)}")
    return {k: float(v[1]) for k, v in found.items()}, end + len(END)


def cells(files: DataFrame) -> DataFrame:
    """Each cell of the files (path and content, as `binaryFile` gives them), with its north-west corner; null where
    the file has its fill value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                m, at = metadata(content)
                n, step = int(m["Rows"] * m["Columns"]), m["CellSize"] / 1e6
                value = np.frombuffer(content, "<f4", n, at).astype(float)
                row, col = np.divmod(np.arange(n), int(m["Columns"]))
                columns = [
                    pa.array([path] * n),
                    pa.array(row.astype(np.int32)),
                    pa.array(col.astype(np.int32)),
                    pa.array(m["WestBound"] / 1e6 + col * step),
                    pa.array(m["NorthBound"] / 1e6 - row * step),
                    pa.array(value, mask=value == np.float32(m["FillValue"])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CELLS.split(", ")])

    return files.select("path", "content").mapInArrow(run, CELLS)
