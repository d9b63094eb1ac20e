"""Sources, sinks and incremental runs."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upland.sources import files, jsonsource
from upland.streaming import incremental


def test_csv_fallback_and_blanks(spark, tmp_path):
    schema = StructType.fromDDL("id string, name string, v double")
    files.write_csv(spark.createDataFrame([("007", "nan", float("nan")), ("8", "x", 2.0)], schema), str(tmp_path / "t"), one_file=True)
    got = files.read_csv(spark, [str(tmp_path / "missing"), str(tmp_path / "t")], schema).collect()
    assert sorted((r.id, r.name, r.v) for r in got) == [("007", None, None), ("8", "x", 2.0)]
    assert files.read_csv(spark, [str(tmp_path / "missing")], schema).count() == 0


def test_records_envelopes(spark):
    bodies = [('{"records": [{"a": 1}]}',), ('{"data": [{"a": 2}]}',), ('{"result": {"records": [{"a": 3}]}}',)]
    assert sorted(r.a for r in jsonsource.records(spark.createDataFrame(bodies, "body string"), "struct<a:int>").collect()) == [1, 2, 3]


def test_every_fifth_vertex(spark):
    body = '{"elements": [{"id": 4, "geometry": [' + ",".join(f'{{"lat": {i}, "lon": 0}}' for i in range(12)) + "]}]}"
    assert sorted(r.lat for r in jsonsource.every_nth_vertex(spark.createDataFrame([(body,)], "body string")).collect()) == [0.0, 5.0, 10.0]


def test_new_files_are_processed_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = StructType.fromDDL("id int, v double")
    double = lambda df: df.withColumn("v", F.col("v") * 2)
    spark.createDataFrame([(1, 1.0)], schema).write.parquet(src)
    assert incremental.process_new_files(spark, src, schema, out, mark, double) == 1
    assert incremental.process_new_files(spark, src, schema, out, mark, double) == 0
    spark.createDataFrame([(2, 2.0)], schema).write.mode("append").parquet(src)
    assert incremental.process_new_files(spark, src, schema, out, mark, double) == 1
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, 2.0), (2, 4.0)]


def test_optional_columns(spark):
    df = files.empty_columns(spark.createDataFrame([(1,)], "id int"), {"id": "int", "v": "double"})
    assert df.first().asDict() == {"id": 1, "v": None}
