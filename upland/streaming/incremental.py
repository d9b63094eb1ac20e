"""Incremental runs: files that have come since the last run are processed once, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upland.sources.panel import widen


def process_new_files(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> int:
    """Apply a row-wise `transform` to files not seen before and append the rows to `sink`; the new rows' number.

    The checkpoint remembers the files, so a rerun adds nothing and a failed run resumes."""
    stream = transform(spark.readStream.schema(schema).format(fmt).load(source))
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


#: Buckets of the panel's keys.
BUCKETS = 16


def _versions(spark: SparkSession, sink: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket in the last manifest, or the last before an epoch; at most a row a bucket."""
    try:
        rows = spark.read.schema("bucket int, version long, epoch long").parquet(f"{sink}/manifest")
    except AnalysisException:  # no batch yet
        return {}
    if before is not None:
        rows = rows.filter(F.col("epoch") < before)
    last = rows.agg(F.max("epoch")).first()[0]
    return {r["bucket"]: r["version"] for r in rows.filter(F.col("epoch") == last).collect()} if last is not None else {}


def _rows_of(spark: SparkSession, sink: str, schema: StructType, versions: dict[int, int]) -> DataFrame:
    paths = [f"{sink}/rows/epoch={version}/bucket={bucket}" for bucket, version in sorted(versions.items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{sink}/rows").parquet(*paths).select(*schema.names)


def merge_batch(batch: DataFrame, sink: str, epoch: int, buckets: int = BUCKETS) -> None:
    """Merge a batch of (id, year, value) into the keyed table `sink`: of one id and year the batch's row wins, of several
    in the batch the one with the largest value.

    Keys are dealt to buckets by a hash of the id. Buckets that the batch touches are read, merged and written anew as
    this epoch's version; the others stay as they are. The manifest, written last, names the version of every bucket, so
    a reader sees the table before or after a batch, and a batch that is replayed goes from the manifest before it."""
    spark, schema = batch.sparkSession, batch.schema
    dealt = batch.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = {r["bucket"] for r in dealt.select("bucket").distinct().collect()}  # at most `buckets`
        if not touched:
            return
        versions = _versions(spark, sink, epoch)
        held = _rows_of(spark, sink, schema, {b: v for b, v in versions.items() if b in touched})
        held = held.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        both = held.withColumn("turn", F.lit(0)).unionByName(dealt.withColumn("turn", F.lit(1)))
        merged = both.groupBy("bucket", "id", "year").agg(F.max_by("value", F.struct("turn", "value")).alias("value"))
        merged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{sink}/rows/epoch={epoch}")
    finally:
        dealt.unpersist()
    manifest = spark.createDataFrame(sorted((versions | dict.fromkeys(touched, epoch)).items()), "bucket int, version long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{sink}/manifest/epoch={epoch}")


def merge_panel(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Merge the files of `source` that haven't been taken yet into the keyed table `sink`, a batch a run."""
    query = spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint)
    query.foreachBatch(lambda batch, epoch: merge_batch(batch, sink, epoch, buckets)).trigger(availableNow=True).start().awaitTermination()


def panel_rows(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """(id, year, value) as of the last batch: the current version of each bucket, and no other file."""
    return _rows_of(spark, sink, schema, _versions(spark, sink))


def merged_panel(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """The wide panel of all batches, later ones winning."""
    return widen(panel_rows(spark, sink, schema))


def compact(spark: SparkSession, sink: str) -> int:
    """Delete the versions of buckets that the last manifest doesn't name, and the manifests before it; how many folders.

    For times without readers of an older manifest; a batch can still be replayed if it is the last."""
    versions = _versions(spark, sink)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([sink, *parts]))
    store, gone = path().getFileSystem(conf), 0
    listed = lambda *parts: [x.getPath().getName() for x in store.listStatus(path(*parts)) if x.isDirectory()] if store.exists(path(*parts)) else []
    last = max((int(x.removeprefix("epoch=")) for x in listed("manifest") if x.startswith("epoch=")), default=None)
    for epoch in listed("manifest"):
        if epoch.startswith("epoch=") and last is not None and int(epoch.removeprefix("epoch=")) < last:
            gone += bool(store.delete(path("manifest", epoch), True))
    for epoch in listed("rows"):
        for bucket in listed("rows", epoch):
            if bucket.startswith("bucket=") and versions.get(int(bucket.removeprefix("bucket="))) != int(epoch.removeprefix("epoch=")):
                gone += bool(store.delete(path("rows", epoch, bucket), True))
    return gone


def with_late(rows: DataFrame, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """`rows` with the columns of a table that a background job may have written by now; nulls while it hasn't."""
    spark = rows.sparkSession
    try:
        late = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # not there yet
        late = spark.createDataFrame([], schema)
    return rows.join(late, key, "left")
