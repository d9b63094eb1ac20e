"""Reading, cutting and size-checked joins of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.sources.store import cut, new_folder

__all__ = ["BROADCAST_ROWS", "bound_batches", "cut", "is_small", "keyed_join", "new_folder", "table"]

#: Rows of a two-column key table that may be broadcast: about 64 MB once hashed.
BROADCAST_ROWS = 2_000_000


#: Of an Arrow batch sent to a Python worker, so that long texts don't make large ones.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4000


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once, in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; it counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a narrow key table: broadcast if a count proves it small, else a shuffled join that AQE may split."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)
