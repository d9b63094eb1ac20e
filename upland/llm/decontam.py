"""Benchmark decontamination: rare n-gram seeds join passages to test items, and Smith-Waterman scores them.

Words are runs of digits, letters and non-ASCII characters of the lower-cased text. Seeds of an item are those of
its n-grams that are rare by true count: in at most RARE of all documents, or FEW; and the rarest of each WINDOW of
them, so that parts of an item that is copied all over the corpus are found, too, unless more than MANY items have
it. So n-grams of a template that many items and documents share are no seeds, and don't meet item by item. An item
with fewer than KEEP seeds takes n-grams up to twice as frequent as its KEEP-th rarest.

A document with a seed is aligned with the seed's item around the place of the seed, by words, with a
Smith-Waterman alignment in two rows; copies with changed, left-out or added words keep most of the score. A pair
counts if the alignment reaches THRESHOLD of the score of the whole item, or matches PASSAGE words or more and
loses no more than a fifth of their score to edits: a long passage counts, however long its item.

Items of more than PART words are taken in parts that overlap by half, each with seeds and a score of its own; the
best part counts, and matched words are that part's. So memory is bounded whatever the length of an item.

The documents are read twice and never shuffled: the items' n-grams, then their seeds, go to every task. Items
beyond SLICE_WORDS words go in slices, each with a pass of its own, so what is sent stays bounded.

Null and empty texts match nothing; items without words have no seeds; repeated documents or items give a
result each. Only doc_id and text, item_id and text are read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upland.llm import textkernel as tk

SEED_WORDS = 3
RARE, FEW = 1e-3, 10
WINDOW, MANY = 8, 16
KEEP = 3
THRESHOLD = 0.4
PASSAGE, IDENTITY = 20, 0.8
PART = 4096
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of the items that are sent to the tasks at once: about 100 MB.
SLICE_WORDS = 2_000_000

RESULT = "doc_id long, item_id long, score double, matched_words long, first_word long, last_word long"


def word_blocks(column: pa.Array) -> Iterator[tuple[int, int, tk.Words]]:
    data, offsets = tk.buffers(pc.utf8_lower(column))
    for i, j in tk.blocks(offsets):
        yield i, j, tk.words(data, offsets, i, j, tk.NOT_ALNUM)


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each item."""
    out: list[np.ndarray] = []
    for i, j, w in word_blocks(pa.array(texts, pa.string())):
        out += [w.hash[w.first[k] : w.first[k + 1]] for k in range(j - i)]
    return out


def in_parts(ids: list, words: list[np.ndarray]) -> tuple[list, list[np.ndarray]]:
    """The items, those of more than PART words in parts that overlap by half."""
    out = [(k, w[at : at + PART]) for k, w in zip(ids, words, strict=True) for at in range(0, max(1, len(w) - PART // 2), PART // 2)]
    return [k for k, _ in out], [w for _, w in out]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    return tk.shingles(tk.Words(words[:0], words, words, np.array([0, len(words)]), words), n)[0]


class Items:
    """The items of a slice: words, and the distinct n-grams of all; an item of fewer words has one n-gram."""

    def __init__(self, ids: list, words: list[np.ndarray], n: int = SEED_WORDS) -> None:
        self.n = n
        self.ids, self.words = in_parts(ids, words)
        self.size = [min(n, len(w)) for w in self.words]
        self.grams = [gram_hashes(w, size) if size else np.zeros(0, np.uint64) for w, size in zip(self.words, self.size, strict=True)]
        self.distinct = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, np.uint64)
        self.sizes = sorted({size for size in self.size if size})

    def seeds(self, frequency: np.ndarray, documents: int) -> Seeds:
        """The items' rare n-grams, by the number of documents that have each distinct n-gram."""
        hashes, items, places = [], [], []
        limit = max(RARE * documents, FEW)
        each = [np.searchsorted(self.distinct, np.unique(g)) for g in self.grams]
        holders = np.bincount(np.concatenate(each), minlength=len(self.distinct)) if each else np.zeros(0)
        for k, grams in enumerate(self.grams):
            if len(grams):
                place = np.searchsorted(self.distinct, grams)
                own = frequency[place]
                windows = np.lib.stride_tricks.sliding_window_view(own, min(WINDOW, len(own)))
                rarest = np.zeros(len(own), bool)
                rarest[np.arange(len(windows)) + windows.argmin(1)] = True
                chosen = (own <= limit) | rarest & (holders[place] <= MANY)
                if chosen.sum() < KEEP:
                    chosen |= own <= 2 * np.sort(own)[min(KEEP, len(own)) - 1]
                at = np.flatnonzero(chosen)
                hashes.append(grams[at])
                items.append(np.full(len(at), k))
                places.append(at)
        if not hashes:
            return Seeds(self, *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)))
        order = np.argsort(np.concatenate(hashes), kind="stable")
        return Seeds(self, *(np.concatenate(x)[order] for x in (hashes, items, places)))


class Seeds:
    """The items of a slice and their seeds, ascending by hash."""

    def __init__(self, items: Items, hashes: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        self.ids, self.words, self.size, self.sizes = items.ids, items.words, np.array(items.size), items.sizes
        self.hash, self.item, self.place = hashes, item, place


def document_frequencies(sent: Broadcast) -> Callable:
    """In how many documents each of the distinct n-grams is, and all documents at -1; one batch a task."""

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, sizes = sent.value
        total, documents = np.zeros(len(distinct), np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for _, _, w in word_blocks(batch.column(0)):
                met = []
                for size in sizes:
                    grams, at = tk.shingles(w, size)
                    place = np.minimum(np.searchsorted(distinct, grams), len(distinct) - 1)
                    hit = np.flatnonzero(distinct[place] == grams)
                    text = np.searchsorted(w.first, at[hit], "right") - 1
                    met.append(text * len(distinct) + place[hit])
                if met:
                    total += np.bincount(np.unique(np.concatenate(met)) % len(distinct), minlength=len(distinct))
        found = np.flatnonzero(total)
        columns = [np.append(found, -1), np.append(total[found], documents)]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["gram", "n"])

    return run


#: A cell of the alignment holds score, matched words and start in the text, in this order of significance.
_SCORE, _MATCHED = 40, 20


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int, int]:
    """Best local alignment: score as a share of the whole item's, matched words, and its range in `text`.

    Of alignments with the same score, that with the most matched words. Two rows are held; rows are computed at
    once: with a linear gap cost, gaps within a row are a running maximum."""
    one = 1 << _SCORE
    fresh = np.arange(len(text) + 1)
    steps = fresh * (-GAP * one)
    row, best, stop = fresh, 0, 0
    for word in item:
        above = row + GAP * one
        above[1:] = np.maximum(above[1:], row[:-1] + np.where(text == word, MATCH * one + (1 << _MATCHED), MISMATCH * one))
        above = np.maximum.accumulate(np.where(above >= one, above, fresh) + steps) - steps
        row = np.where(above >= one, above, fresh)
        at = int(row.argmax())
        if row[at] > best:
            best, stop = int(row[at]), at
    if best < one:
        return 0.0, 0, 0, 0
    low = (1 << _MATCHED) - 1
    return (best >> _SCORE) / (MATCH * len(item)), best >> _MATCHED & low, best & low, stop


def matches(seeds: Seeds, threshold: float, column: pa.Array) -> Iterator[tuple[int, int, float, int, int, int]]:
    """Text, item, score, matched words and range of words of every pair of text and item or part that counts."""
    if not len(seeds.hash):
        return
    for i, _, w in word_blocks(column):
        found: dict[tuple[int, int], list[int]] = {}
        for size in seeds.sizes:
            grams, at = tk.shingles(w, size)
            low = np.searchsorted(seeds.hash, grams)
            hit = np.flatnonzero(np.append(seeds.hash, 0)[low] == grams)
            high = np.searchsorted(seeds.hash, grams[hit], "right")
            texts = np.searchsorted(w.first, at[hit], "right") - 1
            for k, text, a, b in zip(at[hit].tolist(), texts.tolist(), low[hit].tolist(), high.tolist(), strict=True):
                for s in range(a, b):
                    item = int(seeds.item[s])
                    if seeds.size[item] == size:
                        found.setdefault((text, item), []).append(k - int(seeds.place[s]))
        for (text, item), starts in sorted(found.items()):
            own, best = seeds.words[item], (0.0, 0, 0, 0)
            first, last, slack = int(w.first[text]), int(w.first[text + 1]), len(own) // 2 + 2
            for low, high in merged(starts, len(own) + slack, slack):
                low, high = max(first, low), min(last, high)
                for a, b in pieces(low, high, len(own)):
                    score, matched, p, q = align(own, w.hash[a:b])
                    best = max(best, (score, matched, a + p - first, a + q - first), key=lambda x: x[0])
            score, matched = best[:2]
            if score >= threshold or matched >= PASSAGE and score * len(own) >= IDENTITY * matched:
                yield i + text, item, *best


def best_of_items(seeds: Seeds, threshold: float, column: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
    """`matches`, with one row for the parts of an item."""
    best: dict[tuple, tuple] = {}
    for m in matches(seeds, threshold, column):
        key = m[0], seeds.ids[m[1]]
        if key not in best or best[key][2:4] < m[2:4]:
            best[key] = m
    return list(best.values())


def merged(starts: list[int], after: int, before: int) -> list[tuple[int, int]]:
    """Ranges around where an item would start, overlapping ones as one."""
    out: list[list[int]] = []
    for s in sorted(set(starts)):
        if out and s - before <= out[-1][1]:
            out[-1][1] = s + after
        else:
            out.append([s - before, s + after])
    return [(a, b) for a, b in out]


def pieces(low: int, high: int, size: int, limit: int = 4096) -> Iterator[tuple[int, int]]:
    """A long range in parts that overlap by twice the item, so memory is bounded and no copy is cut."""
    step = max(limit, 4 * size)
    while True:
        yield low, min(high, low + step)
        if low + step >= high:
            return
        low += step - 2 * size


def slices(items: DataFrame) -> Iterator[tuple[list[int], list[str | None]]]:
    """The items, in slices of at most SLICE_WORDS words (by their length in characters)."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"] or "") // 4 + 1
        if ids and size + n > SLICE_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    if ids:
        yield ids, texts


def seeds_of(docs: DataFrame, ids: list[int], texts: list[str | None]) -> Broadcast:
    """The rare seeds of a slice of items, by the n-grams' frequencies in all documents, as a broadcast variable."""
    context = docs.sparkSession.sparkContext
    items = Items(list(enumerate(ids)), item_words(texts))
    frequency, documents = np.zeros(len(items.distinct)), 0
    if len(items.distinct):
        sent = context.broadcast((items.distinct, items.sizes))
        found = docs.select(F.col("text").cast("string")).mapInArrow(document_frequencies(sent), "gram long, n long")
        counted = found.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # no more rows than the slice has n-grams
        gram, n = counted["gram"].to_numpy(), counted["n"].to_numpy()
        frequency[gram[gram >= 0]] = n[gram >= 0]
        documents = int(n[gram < 0].sum())
    return context.broadcast(items.seeds(frequency, documents))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, matched_words, first_word and last_word (exclusive) of every pair that counts."""
    out = None
    for ids, texts in slices(items):
        seeds = seeds_of(docs, ids, texts)

        @tk.lean
        def run(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = best_of_items(seeds.value, threshold, batch.column("text"))
                if found:
                    texts, items, *rest = zip(*found, strict=True)
                    own = pa.array([seeds.value.ids[k][1] for k in items], pa.int64())
                    columns = [batch.column("doc_id").take(pa.array(texts)), own, *map(pa.array, rest)]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def leaks(seeds: Broadcast, threshold: float):
    """A column function: whether a text holds a passage of an item."""

    @F.arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        found = np.zeros(len(column), bool)
        found[[m[0] for m in matches(seeds.value, threshold, column)]] = True
        tk.give_back()
        return pa.array(found)

    return run


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that no item is found in, with their columns as they are."""
    for ids, texts in slices(items):
        docs = docs.filter(~leaks(seeds_of(docs, ids, texts), threshold)(F.col("text").cast("string")))
    return docs
