"""run() against a plain version of its stages, on planted foreign, copied and contaminated documents."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_brute_force import FOREIGN, SPACE_WORDS, components_by_hand, plain_alignment, water
from upland.llm import decontam, langid, tokenbin

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    import re

    return np.array([hash(x) for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())])


@pytest.fixture(scope="module")
def planted(spark, sf_dir, tmp_path_factory):
    """The smallest fixture with planted rows, as a folder, and what was planted."""
    random.seed(12)
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    long = [r for r in rows if r[1] and 150 < len(r[1].split()) < 600 and r[2]]
    foreign = [(9000 + k, t * 6, None, "a", 1) for k, t in enumerate(FOREIGN)]
    exact = [(9100 + k, long[k][1], long[k][2], "z", 1) for k in range(3)]
    near = []
    for k in range(3, 6):
        w = long[k][1].split(" ")
        w[len(w) // 2] = "changed"
        near.append((9200 + k, " ".join(w), long[k][2], "a", 1))
    leaked = [(9300 + k, f"{long[6 + k][1]} {items[k]} {long[9 + k][1]}", long[6 + k][2], "b", 1) for k in range(3)]
    odd = [(9400, None, "en", "a", 0), (9401, "", None, None, 0), (9402, "12345 !!!", "de", "b", 1)]
    folder = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([*rows, *foreign, *exact, *near, *leaked, *odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("copies", F.lit("x")).withColumn("node", F.lit(1)).write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    gone = {r[0] for r in [*foreign, *exact, *near, *leaked, *odd]}
    return str(folder), gone, items


def test_run_against_a_plain_version(spark, planted):
    folder, gone, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}

    model = spark.sparkContext.broadcast(langid.fit(docs.filter(~langid.held_out())))
    rejected = {r.doc_id for r in docs.filter(langid.predict(model, F.col("text"))["rejected"]).select("doc_id").collect()}
    assert {9000, 9001, 9002, 9400, 9401, 9402} <= rejected and len(rejected) < 0.1 * len(text)
    kept = {i: t for i, t in text.items() if i not in rejected}
    kept = {i: kept[i] for i, (n, c) in components_by_hand(kept.items(), 5, 80, 100).items() if not n or c == i}
    tests = [words(x) for x in items]

    def leaks(t):
        w = words(t)
        near = [x for x in tests if len(np.intersect1d(x, w)) >= 0.4 * min(len(x), 2 * decontam.PASSAGE)]
        return any(plain_alignment(x, w) >= decontam.THRESHOLD * decontam.MATCH * len(x) for x in near)

    kept = {i: t for i, t in kept.items() if not leaks(t)}
    assert not gone & set(kept)

    rows = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r.start)
    copies = Counter(r.doc_id for r in rows)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    size = {i: len(SPACE_WORDS.findall(t or "")) for i, t in kept.items()}
    totals, taken = Counter(), Counter()
    for i, n in size.items():
        totals[source[i]] += n
        taken[source[i]] += n * copies[i]
    want = water(totals)
    for s in totals:  # one document of a source, at most, lies between what is taken and its target
        assert abs(taken[s] - want[s]) <= max(n for i, n in size.items() if source[i] == s)

    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(tokenbin.vocabulary_file()), 0
    ids = {i: np.array([*tokenizer.encode(kept[i], add_special_tokens=False).ids, 0], "<u4") for i in copies}
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens


def test_stages_keep_the_columns(spark, planted):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "source_mix", "token_ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema == docs.schema
