"""Quality rules as a short-circuit cascade, with DataFrame operations only.

The rules' costs and rejections are estimated on a sample of about SAMPLE documents; the cascade then tries
them in the order of rejections per cost, each among what the ones before it would leave, and stops at the
first that rejects. The order changes the work, never the verdict.

Words are runs of characters other than 0x20 and 0x09 to 0x0D. Null and empty texts have no words and fail the
base. Each row is judged alone, so repeated rows agree; columns beyond doc_id and text don't matter; an empty
table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.llm.common import cut

SAMPLE = 2000
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent words of the languages that are kept (fixed values).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "as", "with", "be", "by", "are", "this", "from", "or",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "avec",
    "el", "los", "las", "y", "que", "del", "se", "por", "con", "para", "su", "al", "lo", "como", "no", "una", "más", "pero", "sus", "le",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more: windows are sorted by hash, equal
    neighbours compared word by word, and the places they cover counted once."""
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def covered(w: Column, s: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            p, q = a["p"], b["p"]
            return (a["h"] == b["h"]) & (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))

        def repeated(k: Column) -> Column:
            before = (k > 0) & same(F.get(s, k), F.get(s, k - 1))
            return before | ((k < F.size(s) - 1) & same(F.get(s, k), F.get(s, k + 1)))

        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), repeated), lambda k: F.get(s, k)["p"]))
        return let(places, lambda p: F.when(F.size(p) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda n, k: n + F.when(k < F.size(p) - 1, F.least(F.lit(3), F.get(p, k + 1) - F.get(p, k))).otherwise(3))))

    found = let(words, lambda w: let(F.sort_array(hashed(w)), lambda s: covered(w, s)))
    return F.when(F.size(words) < 3, 0).otherwise(found).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, lines and the base counts of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut_up = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = cut_up.select(
        "doc_id",
        "text",
        "words",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def rules() -> dict[str, Column]:
    """Each true where its rule rejects a document that passed the base."""
    upper = F.regexp_count("text", F.lit(r"\p{Lu}"))
    digits = F.length("text") - F.length(F.translate("text", "0123456789", ""))
    stops = F.array_intersect("words", F.array(*map(F.lit, dict.fromkeys(STOP_WORDS))))
    return {
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "long_words": F.col("word_chars") > 14 * F.col("n_words"),
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "digits": 10 * digits > 3 * F.col("word_chars"),
        "capitals": 10 * upper > 6 * F.col("word_chars"),
        "few_stop_words": F.size(stops) < 2,
    }


def measured_costs(sample: DataFrame, checks: dict[str, Column]) -> dict[str, float]:
    """Seconds that each rule takes over the sample, beyond those of a run without a rule; a millisecond at least."""

    def seconds(check: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(check)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    idle = seconds(F.col("n_words") < 0)
    return {name: max(seconds(check) - idle, 1e-3) for name, check in checks.items()}


def order_rules(sample: DataFrame, checks: dict[str, Column], cost: dict[str, float]) -> list[str]:
    """The rules by rejections per cost on a measured sample, each among what the earlier ones leave; of equals the
    cheaper one first, then the last by name."""
    passed = sample.filter(~F.col("base_failed"))
    verdicts = passed.groupBy(*[check.alias(name) for name, check in checks.items()]).count().collect()  # at most 2 to the number of rules
    order: list[str] = []
    while len(order) < len(checks):
        rejected = {name: sum(r["count"] for r in verdicts if r[name]) for name in checks if name not in order}
        order.append(max(rejected, key=lambda name: (rejected[name] / cost[name], -cost[name], name)))
        verdicts = [r for r in verdicts if not r[order[-1]]]
    return order


def cascade(checks: dict[str, Column], order: list[str]) -> Column:
    """Whether a document passes: rules are tried in turn, and none after the first that rejects."""
    verdict = F.when(F.col("base_failed"), False)
    for name in order:
        verdict = verdict.when(checks[name], False)
    return verdict.otherwise(True)


def judge(docs: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document; one pass and no shuffle."""
    checks = rules()
    share = min(1.0, sample_rows / max(1, docs.count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    sample = cut(measured(docs.filter(draw < share)), "quality-sample")
    order = order_rules(sample, checks, measured_costs(sample, checks))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    return measured(docs).select("doc_id", *counts, "base_failed", cascade(checks, order).alias("kept"))
