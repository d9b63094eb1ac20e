"""Exact duplicates of whole texts, by a stream whose keyed state is kept on disk and never expires.

A file stream reads the documents, new files only if it has run before, and counts them by the digest of their text.
The state, held by RocksDB stores whose changes go to the checkpoint folder, retains for each digest

    size        how many rows had it
    keep        of the row that stays: its doc_id (the stable identifier), and where its content lies (file and row)

so it grows with distinct texts, not with their length. Rows are counted by digest within each task before they are
sent, so a group of copies of any size is a row a task. Of one digest the row of the largest doc_id stays; of rows
that share it too, the one whose file and row come last.

A digest that was hit more than once is checked against the full bytes: the rows of hit digests are read again, and
the smallest and largest text of each digest compared, again first within each task. If they differ, the digest
stands for several texts, and its rows are grouped by the texts themselves.

Null text counts as empty; a null doc_id is smaller than any; repeated rows count each, and one of them is kept. An
empty table gives no rows. Files that were read must stay as they are; new ones may come. Only doc_id and text are
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.llm.common import cut, keyed_join, new_folder

#: Bytes of files in a micro-batch.
BATCH = 64 << 30
STORES = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores takes megabytes ahead
}

Key = Callable[[Column], Column]


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(files: DataFrame, key: Key) -> DataFrame:
    """doc_id, place (file and row), text, text_sha256 and digest of rows read from files."""
    rows = files.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return rows.withColumn("digest", key(F.col("text_sha256")))


def remember(spark: SparkSession, path: str, checkpoint: str, key: Key = F.unhex, batch: int = BATCH) -> DataFrame:
    """Take the files of `path` that the state in `checkpoint` doesn't know into it; digest, size and keep of all that it
    holds then. The number of its stores is that of shuffle partitions when it was begun."""
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch)
    files = source.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name a file, a plain path only a folder
    kept = F.struct("doc_id", "place.file", "place.row")
    groups = located(files, key).groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.max(kept).alias("keep"))
    with _settings(spark, STORES):
        query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        return cut(state.select("key.digest", F.col("value.count").alias("size"), F.col("value.max").alias("keep")), "dedup-state")


def colliding(texts: DataFrame, hit: DataFrame) -> DataFrame:
    """Digests of `hit` whose rows' bytes aren't all the same."""
    near = keyed_join(texts.withColumn("short", F.xxhash64("digest")), hit.select(F.xxhash64("digest").alias("short")), ["short"], "left_semi")
    ends = near.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    return ends.filter("least != most").select("digest")


def deduplicate(spark: SparkSession, path: str, checkpoint: str | None = None, key: Key = F.unhex, batch: int = BATCH) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row in the Parquet files of `path`.

    `checkpoint` is the folder of a state to go on with, a new one if None. `key` makes the digest of the hexadecimal
    SHA-256; a shorter one costs more checks, never exactness."""
    state = remember(spark, path, checkpoint or new_folder(spark, "dedup"), key, batch)
    rows = located(spark.read.parquet(path), key)
    hit = state.filter("size > 1")
    apart = cut(colliding(rows.select("digest", "text"), hit), "dedup-colliding")

    out = rows.select("doc_id", "place", "text_sha256", "digest")
    met = out.join(hit, "digest", "left")
    if not apart.isEmpty():
        met = met.join(apart, "digest", "left_anti")
        both = keyed_join(rows, apart, ["digest"], "left_semi")
        texts = both.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("doc_id", "place.file", "place.row")).alias("keep"))
        met = met.unionByName(both.join(texts, ["digest", "text"]).drop("text"))
    alone = F.col("size").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("keep.file") == F.col("place.file")) & (F.col("keep.row") == F.col("place.row")))).alias("kept"),
        "text_sha256",
    )


def deduplicate_rows(docs: DataFrame, **options) -> DataFrame:
    """`deduplicate` of rows that aren't in files yet: they are written first."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "dedup-input")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).write.parquet(folder)
    return deduplicate(spark, folder, **options)
