"""Language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of byte n-grams of its lower-cased letters (2 to 4 bytes, hashed to
FEATURES cells). Each language has several centroids, found by spherical k-means; a text takes the language of
the centroid with the largest cosine, and is rejected where that cosine is far below what the language's own
training texts of about its length reach.

Document frequencies and the cosines below which texts are rejected come from all training rows. The centroids
are fitted on a bounded sample: about `per_language` distinct rows of each language, chosen by a hash of doc_id and
text (documented bound, 1,000 by default); rows of one doc_id are told apart by their texts, and equal rows count
once. The model holds `centroids` vectors for each language, and it and a histogram of cosines for each language
and length are all that reaches the driver; it goes to the tasks as a broadcast variable.

Null text and text without a letter give `und` with score 0, rejected. Rows of null lang or without a letter
teach nothing; without any training row every text is `und`. Ties go to the first language in code-point
order. Only the text decides a prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.llm import textkernel as tk

FEATURES = 1 << 13
SIZES = (2, 3, 4)
PER_LANGUAGE = 1000
CENTROIDS = 4
#: A text is rejected below this part of the cosine that 99 of 100 training texts of the language and length
#: (by powers of two, LENGTHS of them) reach; a length with fewer than LEAST_ROWS such texts takes the bound of the
#: sample's texts cut to that length, which 99 of 100 of them reach in full, or else of the nearest length that has
#: one. Cosines are counted in BINS.
REJECT, LENGTHS, LEAST_ROWS, BINS = 0.5, 24, 20, 4096
CUTS = 13  # texts are cut to 2, 4, ... 4,096 characters

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[:] = 0x20
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


class Model(NamedTuple):
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # normalised, one a row, over FEATURES cells
    idf: np.ndarray
    least: np.ndarray  # of each centroid and length, the cosine below which a text is rejected


def counts(column: pa.Array) -> Iterator[np.ndarray]:
    """For each block of texts, how often each of its texts has each n-gram."""
    data, offsets = tk.buffers(pc.utf8_lower(column))
    for i, j in tk.blocks(offsets, 1 << 20):
        for a in range(i, j, 128):  # 128 rows of FEATURES cells at most
            yield _counts(data, offsets[a : min(a + 128, j) + 1])


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    text = _LETTERS[data[offsets[0] : offsets[-1]]]
    row = np.repeat(np.arange(n), np.diff(offsets))
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 0x20) | (text[:-1] != 0x20) | (row[1:] != row[:-1])
    text, row = text[keep].astype(np.uint32), row[keep]
    out = np.zeros(n * FEATURES, np.int64)
    for size in SIZES:
        if len(text) < size:
            break
        gram = text[: len(text) - size + 1].copy()
        for k in range(1, size):
            gram = gram << np.uint32(8) | text[k : len(text) - size + 1 + k]
        cell = (gram * np.uint32(0x9E3779B1) + np.uint32(size)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - 13)
        own = row[: len(cell)] == row[size - 1 :]
        out += np.bincount(row[: len(cell)][own] * FEATURES + cell[own], minlength=n * FEATURES)
    return out.reshape(n, FEATURES)


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    return pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)


def length_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + count.sum(1)).astype(int), LENGTHS - 1)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count).astype(np.float32) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


@tk.lean
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have each cell, and all texts at cell FEATURES; one batch a task."""
    total = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        text = batch.column(0).filter(pa.array(lettered(batch.column(0))))
        for count in counts(text):
            total[:-1] += (count > 0).sum(0)
            total[-1] += len(count)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(total)], names=["cell", "n"])


@tk.lean
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = pa.array(lettered(batch.column("text")))
        batch = batch.filter(ok)
        raw = [row.tobytes() for count in counts(batch.column("text")) for row in np.minimum(count, 65535).astype("<u2")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(raw, pa.binary())], names=["lang", "doc_id", "counts"])


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; deterministic."""
    mean = x.mean(0)
    centre = [int((x @ mean).argmax())]
    near = x @ x[centre[0]]
    while len(centre) < min(k, len(x)):
        centre.append(int(near.argmin()))
        near = np.maximum(near, x @ x[centre[-1]])
    c = x[centre]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def drawn_rows(train: DataFrame, per_language: int) -> DataFrame:
    """lang, doc_id and text of about `per_language` distinct rows of each language."""
    mark = F.xxhash64(F.lit("langid"), "doc_id", "text")
    marked = train.withColumn("mark", mark)
    sizes = marked.groupBy("lang").agg(F.approx_count_distinct("mark").alias("rows_of_lang"))
    draw = F.shiftrightunsigned(F.col("mark"), 11) / F.lit(float(1 << 53))
    # a row a language, as the model has too; texts aren't shuffled to be thrown away
    drawn = marked.join(F.broadcast(sizes), "lang").filter(draw < F.lit(per_language) / F.col("rows_of_lang"))
    return drawn.select("lang", "doc_id", "text", "mark").dropDuplicates(["lang", "mark"]).drop("mark")


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learn from `doc_id`, `text` and `lang` of `train`: one pass over all texts, one over the sample."""
    train = train.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null")
    found = train.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES + 1)
    df[found.cell.to_numpy()] = found.n.to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.05)
    sample = drawn_rows(train, per_language)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "counts"])
        count = np.stack([np.frombuffer(c, "<u2") for c in rows["counts"]])
        c = _cluster(vectors(count, idf), centroids)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "vector": [v.astype("<f4").tobytes() for v in c]})

    rows = sample.mapInArrow(_sampled, "lang string, doc_id long, counts binary").groupBy("lang").applyInPandas(group, "lang string, vector binary").toPandas()
    rows = rows.sort_values(["lang", "vector"])
    stacked = np.stack([np.frombuffer(v, "<f4") for v in rows["vector"]]) if len(rows) else np.zeros((0, FEATURES), np.float32)
    names = list(rows["lang"])
    sent = train.sparkSession.sparkContext.broadcast((stacked, idf))
    cut_at = F.explode(F.array(*[F.lit(1 << k) for k in range(1, CUTS)])).alias("size")
    starts = sample.select("lang", "text", cut_at).filter(F.length("text") > F.col("size")).select("lang", F.expr("substring(text, 1, size)").alias("text"))

    def histograms(texts: DataFrame) -> dict[str, np.ndarray]:
        if not names:
            return {}
        found = texts.mapInArrow(_cosines(names, sent), "lang string, cell int, n long")
        seen = found.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
        return {k: np.bincount(part["cell"].astype(int), part["n"], LENGTHS * BINS).reshape(LENGTHS, BINS) for k, part in seen.groupby("lang")}

    bounds = thresholds(histograms(train.select("lang", "text")), histograms(starts))
    return Model(names, stacked, idf, np.array([bounds[k] for k in names]).reshape(-1, LENGTHS))


def _cosines(names: list[str], sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many texts of each language have each length and cosine to the nearest of its centroids; one batch a task."""
    languages = list(dict.fromkeys(names))
    place = np.array([languages.index(k) for k in names])

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, idf = sent.value
        total = np.zeros(len(languages) * LENGTHS * BINS, np.int64)
        for batch in batches:
            batch = batch.filter(pa.array(lettered(batch.column("text"))))
            own, at = pc.fill_null(pc.index_in(batch.column("lang"), pa.array(languages, pa.string())), -1).to_numpy(zero_copy_only=False), 0
            for count in counts(batch.column("text")):
                lang = own[at : at + len(count)]
                at += len(count)
                cosine = np.where(place == lang[:, None], vectors(count, idf) @ centroids.T, -1.0).max(1)
                bins = np.clip((cosine * BINS).astype(np.int64), 0, BINS - 1)
                np.add.at(total, ((lang * LENGTHS + length_class(count)) * BINS + bins)[lang >= 0], 1)
        k = np.flatnonzero(total)
        cells = LENGTHS * BINS
        columns = [pa.array(languages, pa.string()).take(pa.array(k // cells)), pa.array((k % cells).astype(np.int32)), pa.array(total[k])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "cell", "n"])

    return run


def thresholds(whole: dict[str, np.ndarray], starts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """For each language and length the cosine below which a text is rejected, from the histograms of the cosines of
    its texts and of their starts.

    A language none of whose lengths has LEAST_ROWS texts or starts is bounded by all its texts; one with fewer in
    all takes the least bound of the other languages, and without any such language nothing is rejected."""

    def bound(cells: np.ndarray, part: float = REJECT) -> float:
        return float(np.searchsorted(np.cumsum(cells), 0.01 * cells.sum(), "right")) / BINS * part

    out: dict[str, np.ndarray] = {}
    for lang, grid in whole.items():
        cut = starts.get(lang, np.zeros_like(grid))
        part = np.where(grid.sum(1) >= LEAST_ROWS, REJECT, 1.0)
        grid = np.where(grid.sum(1, keepdims=True) >= LEAST_ROWS, grid, grid + cut)
        enough = np.flatnonzero(grid.sum(1) >= LEAST_ROWS)
        if whole[lang].sum() < LEAST_ROWS:
            continue
        if len(enough):
            out[lang] = np.array([bound(grid[j], part[j]) for j in enough[np.abs(enough[None] - np.arange(LENGTHS)[:, None]).argmin(1)]])
        else:
            out[lang] = np.full(LENGTHS, bound(whole[lang].sum(0)))
    lowest = np.min(list(out.values()), axis=0) if out else np.zeros(LENGTHS)
    return {lang: out.get(lang, lowest) for lang in whole}


def predict(sent: Broadcast, text: Column) -> Column:
    """struct<lang, score, rejected> of a text column, by a broadcast model."""

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def run(column: pa.Array) -> pa.Array:
        model: Model = sent.value
        n = len(column)
        best, score, size = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        if model.languages:
            at = 0
            for count in counts(column):
                cosine = vectors(count, model.idf) @ model.centroids.T
                best[at : at + len(count)] = cosine.argmax(1)
                score[at : at + len(count)] = cosine.max(1)
                size[at : at + len(count)] = length_class(count)
                at += len(count)
        ok = lettered(column) & bool(model.languages)
        names = np.array([*model.languages, "und"], object)[np.where(ok, best, len(model.languages))]
        least = np.vstack([model.least, np.full((1, LENGTHS), 2.0)])[np.where(ok, best, len(model.languages)), size]
        score = np.clip(np.where(ok, score, 0), 0, 1)
        tk.give_back()
        columns = [pa.array(names, pa.string()), pa.array(score), pa.array(score < least)]
        return pa.StructArray.from_arrays(columns, names=["lang", "score", "rejected"])

    return run(text.cast("string"))


def held_out() -> Column:
    """Rows that the query never learns from; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document, learning from those not held out."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out())))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), predict(sent, F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out())))
    return docs.filter(~predict(sent, F.col("text"))["rejected"])
