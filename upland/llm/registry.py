"""Queries of the training-data operators, one thin query each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upland.llm import (
    brown,
    decontam,
    dedup,
    divergence,
    htmltext,
    jaccard,
    langid,
    licences,
    mixing,
    oracles,
    phrases,
    quality,
    secrets,
    tokenbin,
)
from upland.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.encode_documents(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def licence_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `op1_license_scan` that SQL can express."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `op4_lm_scores` that SQL can express."""
    rows = op4_lm_scores(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of `op6_source_mix` that SQL can express."""
    return op6_source_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_quality_rules,
        op3_decontamination,
        op4_lm_scores,
        op5_jaccard_join,
        op6_source_mix,
        op7_language_id,
        op8_html_text,
        op9_token_ids,
        op10_secret_scan,
        op11_phrase_collocations,
        op12_source_divergence,
        op13_exact_dedup,
        licence_base,
        lm_base,
        mix_targets,
    )
}

#: Models, alignments, layouts and files are beyond SQL; tests/llm holds those queries against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": oracles.quality_rules(),
    "op5_jaccard_join": oracles.jaccard(),
    "op11_phrase_collocations": oracles.collocations(),
    "op12_source_divergence": oracles.source_divergence(),
    "op13_exact_dedup": oracles.exact_dedup(),
    "licence_base": oracles.licence_base(),
    "lm_base": oracles.lm_base(),
    "mix_targets": oracles.mix_targets(),
}
