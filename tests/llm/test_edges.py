"""Nulls, empty and repeated rows, ties, clashing columns and empty tables, for every operator."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from upland.llm import brown, decontam, htmltext, jaccard, langid, licences, mixing, quality, secrets, tokenbin

LONG = "the of and " * 20000
ROWS = [
    (1, "The MIT License of the code and the rest of it.", "en", "a"), (1, "The MIT License of the code and the rest of it.", "en", "a"), (2, None, "en", "b"), (3, "", None, None), (4, " \n\t ", "de", "b"),
    (5, "12345 --- !!!", "de", ""), (None, "der die und das ist ein Satz", "de", "c"), (6, LONG, "en", "a"), (7, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in this', None, "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = {c: "x" for c in ("size", "target", "n", "words", "token", "component", "score", "value", "row", "held_out", "path", "copies", "u", "before", "document", "node")}

OPERATORS = {
    "licences": licences.scan_documents, "quality": quality.judge, "brown": brown.score, "jaccard": jaccard.jaccard_components, "mixing": mixing.mix, "langid": langid.identify,
    "tokenbin": tokenbin.encode_documents, "secrets": secrets.scan,
}
ONE_ROW_EACH = set(OPERATORS) - {"secrets"}
#: What equal rows needn't have in common: their place in the files, and whole copies rounded from one rate.
OF_EACH_ROW = ("start", "copies", "taken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASHES.items()}).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, docs):
    rows = OPERATORS[name](docs).collect()
    if name in ONE_ROW_EACH:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
        ones = [r.asDict() for r in rows if r.doc_id == 1]
        for r in ones:
            for own in OF_EACH_ROW:
                r.pop(own, None)
        assert ones[0] == ones[1]
    else:
        assert {r.doc_id for r in rows} == {7}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, docs):
    assert OPERATORS[name](docs.filter("false")).collect() == []


def test_decontamination_edges(spark, docs):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "the rest of it")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(1, 3)}
    assert decontam.contaminated(docs, items.filter("false")).collect() == []
    assert decontam.contaminated(docs.filter("false"), items).collect() == []
    assert decontam.keep_clean(docs, items).columns == docs.columns


def test_pages_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>The man of the sea and the sun is in the town of the hill for a day of rest"), (None, "u", "<article><p>One.</p>&am")]
    got = htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert {r.page_id: r.n_chars for r in got}[1] == 0 and {r.page_id: r.text for r in got}[None] == "One.\n\n&am"
    assert all(r.n_chars == len(r.text) for r in got)


def test_filters_keep_columns(spark, docs):
    for stage in (langid.keep_identified, jaccard.keep_one, mixing.repeat):
        assert stage(docs).columns == docs.columns
    assert [r.doc_id for r in jaccard.keep_one(docs).filter("doc_id = 1").collect()] == [1]


def test_token_ids_of_edges(docs):
    rows = sorted(tokenbin.encode_documents(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows}[2] == (1, zlib.crc32(b"\0\0\0\0"))


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_texts_are_not_shuffled_to_draw_a_sample(spark):
    rows = spark.createDataFrame([(k, f"text of row {k}", "ab"[k % 2]) for k in range(400)], "doc_id long, text string, lang string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sample = langid.drawn_rows(rows, 20)
        plan = sample._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert 10 < sample.count() < 90
