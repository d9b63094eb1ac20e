"""Exact deduplication: state across batches and runs, digests that collide, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from upland.llm import dedup
from upland.llm.common import new_folder

SCHEMA = "doc_id long, text string"


def plain(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


def same(df, rows):
    got = df.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})


def rows_of(n=300):
    hot = [(k, "the copied text " * 40) for k in range(0, n, 3)]
    loose = [(k, f"text {k % 97}") for k in range(1, n, 3)]
    return hot + loose + [(5000, None), (5001, ""), (None, ""), (None, "lost"), (None, "lost"), (7, "again"), (7, "again"), (8, "Again"), (9, "again "), (10, "é"), (11, "é"), (12, "x" * 300_000), (13, "x" * 300_000), (14, "x" * 299_999)]


@pytest.mark.parametrize("key", [F.unhex, lambda h: F.substring(h, 1, 1), lambda h: F.lit("all")], ids=["whole", "four bits", "one"])
def test_digests_that_collide(spark, key):
    """With a digest of four bits, or none, every hit is another text or the same, as the bytes say."""
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "size", "keep", "place")}).repartition(5)
    same(dedup.deduplicate_rows(df, key=key), rows)


def test_state_goes_on_with_new_files(spark):
    folder, checkpoint = new_folder(spark, "dedup-files"), new_folder(spark, "dedup-state")
    parts = [rows_of()[k::3] for k in range(3)]
    for k in range(3):
        spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        seen = [r for p in parts[: k + 1] for r in p]
        same(dedup.deduplicate(spark, folder, checkpoint), seen)
    state = dedup.remember(spark, folder, checkpoint)  # nothing new: nothing is counted twice
    assert state.agg(F.sum("size")).first()[0] == sum(map(len, parts))
    assert state.count() == len({t or "" for p in parts for _, t in p})


def test_many_small_batches(spark, monkeypatch):
    """Files come in batches of a few bytes, so every hit is on state that an earlier batch left on disk."""
    folder = new_folder(spark, "dedup-files")
    spark.createDataFrame(rows_of(60), SCHEMA).repartition(4).write.parquet(folder)
    same(dedup.deduplicate(spark, folder, batch=1), rows_of(60))


def test_empty_table_and_settings(spark):
    before = {k: spark.conf.get(k, None) for k in dedup.STORES}
    assert dedup.deduplicate_rows(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {k: spark.conf.get(k, None) for k in dedup.STORES} == before


def test_counts_before_the_shuffle(spark, sf_dir):
    """A group of copies is a row a task: rows are counted by digest before they are sent."""
    rows = dedup.located(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.unhex)
    plan = rows.groupBy("digest").agg(F.count(F.lit(1)), F.max("place"))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "partial_count" in below and "partial_max" in below
