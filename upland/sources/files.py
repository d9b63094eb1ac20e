"""File sources and sinks with explicit schemas, blank handling and fallbacks."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType


#: Media types of uploaded files (fixed values).
CONTENT_TYPES = {"csv": "text/csv", "json": "application/json", "html": "text/html", "tif": "image/tiff", "png": "image/png"}


def without_nan(df: DataFrame) -> DataFrame:
    """NaN, and strings that stand for a missing value, become null; every source does this."""
    def clean(f):
        if isinstance(f.dataType, DoubleType | FloatType):
            return F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, StringType):
            return F.when(~F.trim(f.name).isin("", "nan", "None"), F.col(f.name)).alias(f.name)
        return F.col(f.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def read_csv(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """The first of the paths that can be read, else an empty table; ids stay strings by the schema."""
    for path in paths:
        try:
            return without_nan(spark.read.schema(schema).option("header", True).csv(path))
        except (AnalysisException, Py4JJavaError):
            continue
    return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; `one_file` is for shortlists."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def content_type(path: Column) -> Column:
    """The media type of a file by the ending of its name."""
    ending = F.lower(F.substring_index(path, ".", -1))
    out = F.lit("application/octet-stream")
    for name, kind in CONTENT_TYPES.items():
        out = F.when(ending == name, kind).otherwise(out)
    return out


def empty_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the columns that a missing optional table would have brought, as nulls of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in `order`."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place_of_row", place).filter("place_of_row = 1").drop("place_of_row")
