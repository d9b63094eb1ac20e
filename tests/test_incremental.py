"""The keyed table of incremental runs, and contracts observed while a table is written."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from upland.operators import validation
from upland.sources.store import new_folder
from upland.streaming import incremental

SCHEMA = StructType([StructField("id", LongType()), StructField("year", IntegerType()), StructField("value", DoubleType())])


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(spark, sink):
    return {(r.id, r.year): r.value for r in incremental.panel_rows(spark, sink, SCHEMA).collect()}


def test_a_batch_rewrites_only_its_buckets(spark):
    sink = new_folder(spark, "keyed")
    first = [(i, 2019, float(i)) for i in range(200)]
    incremental.merge_batch(batch(spark, first), sink, 0, 8)
    before = set(incremental.panel_rows(spark, sink, SCHEMA).inputFiles())
    incremental.merge_batch(batch(spark, [(3, 2019, 33.0), (3, 2020, 1.0), (3, 2020, 2.0)]), sink, 1, 8)
    after = set(incremental.panel_rows(spark, sink, SCHEMA).inputFiles())
    assert len(after & before) == len(before) - 1 and len(after) <= 8
    assert held(spark, sink) == {(i, 2019): v for i, _, v in first} | {(3, 2019): 33.0, (3, 2020): 2.0}


def test_replays_and_corrections(spark):
    sink = new_folder(spark, "keyed")
    batches = [[(i, 2019, 1.0) for i in range(30)], [(i, 2019, 0.5) for i in range(0, 30, 2)], [(40, 2021, 7.0)]]
    for epoch, rows in enumerate(batches):
        for _ in range(2):  # a batch that failed after it wrote comes again
            incremental.merge_batch(batch(spark, rows), sink, epoch, 4)
    want = {(i, 2019): 1.0 if i % 2 else 0.5 for i in range(30)} | {(40, 2021): 7.0}
    assert held(spark, sink) == want
    incremental.merge_batch(batch(spark, []), sink, 3, 4)
    assert held(spark, sink) == want


def test_compaction_keeps_what_is_current(spark):
    sink = new_folder(spark, "keyed")
    assert held(spark, sink) == {} and incremental.compact(spark, sink) == 0
    for epoch in range(5):
        incremental.merge_batch(batch(spark, [(i, 2019, float(epoch)) for i in range(epoch, 20)]), sink, epoch, 4)
    want = held(spark, sink)
    assert want == {(i, 2019): float(min(i, 4)) for i in range(20)}
    assert incremental.compact(spark, sink) >= 4 * 4 - 4 + 4 and held(spark, sink) == want
    on_disk = spark.read.schema(SCHEMA).parquet(f"{sink}/rows")
    assert on_disk.count() == len(want) and incremental.compact(spark, sink) == 0
    incremental.merge_batch(batch(spark, [(1, 2019, 9.0)]), sink, 5, 4)
    assert held(spark, sink) == want | {(1, 2019): 9.0}


def test_contract_is_measured_while_writing(spark, tmp_path):
    seen = []
    spark.range(40).select("id", F.when(F.col("id") % 4 < 3, F.col("id")).alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("contract", "contract")
    try:
        table, found = validation.cut_and_measured(df, "measured", {"v": 0.5}, {"v": 100.0})
        seen = tracker.getJobIdsForGroup("contract")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(seen) == 1 and found == {"rows": 40.0, "share of v": 0.75, "most of v": 38.0}
    assert table.count() == 40
    assert validation.checked(df, "fine", ["id"], 40, {"v": 0.75}, {"v": 38.0}).count() == 40
    with pytest.raises(ValueError, match="40 rows, 50 needed; v: 0.75 present, 0.8 needed; v: 38.0 above 9"):
        validation.checked(df, "bad", ["id"], 50, {"v": 0.8}, {"v": 9})
    with pytest.raises(ValueError, match="missing column w"):
        validation.checked(df, "bad", ["w"], 1, {}, {})
    assert validation.checked(df.filter("false"), "empty", [], 0, {"v": 0.0}, {"v": 1.0}).count() == 0
