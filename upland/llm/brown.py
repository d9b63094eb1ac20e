"""Language-model scores from a Brown class-based bigram model.

    P(text) = product over its tokens of P(class of token | class of the token before) * P(token | its class)

Tokens are the text's words, lower-cased (A-Z), and one end. Classes are found in two steps:

1. the WORDS most frequent training words are assigned to CLASSES classes by the exchange algorithm on the driver:
   words in turn move to the class that most raises the likelihood of the training bigrams, until none moves or
   for ROUNDS rounds;
2. every other word that occurs LEAST times or more in training joins the class that most raises that likelihood
   (to first order) by its own neighbours, counted in one distributed pass. So the classed vocabulary grows with
   the corpus, and what the driver holds doesn't.

Words seen less often, or never, form one class of rare words, and the end, which also stands before a text, one
of its own. Transitions are counted between the classes of all words and smoothed by adding ADD; a word of a class
is emitted by its share of the class, a rare word by (count + 1) / (rare tokens + rare words + 1), which leaves a
share for words never seen.

All counts are over all training documents. The driver and the tasks hold the counts and classes of at most HEAD
frequent words, and the bigrams of WORDS + 2 symbols that occur. Other words stay distributed: their places in the
documents meet the table of counts and classes in one join on the word, each of them rare, and return to their
document as its missing classes; a document is then a string of classes, a byte for each token.

Null text counts as empty and is one end token; without training documents every probability of the base is 1
and of the model that of its smoothing. Repeated rows count and are scored each; only doc_id and text are
read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upland.llm import textkernel as tk
from upland.llm.common import cut

WORDS = 3000
CLASSES = 64
HEAD = 1 << 16
ROUNDS = 15
LEAST = 5
ADD = 0.5
#: In a string of classes, a word whose class isn't known yet.
OPEN = 255


class Head(NamedTuple):
    """Frequent words, known in all tasks; the classes are numbered, then come that of rare words and the end's."""

    word: np.ndarray  # hashes, ascending
    count: np.ndarray
    own: np.ndarray  # class
    rare: int

    @property
    def end(self) -> int:
        return self.rare + 1

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word in the head, and whether it is there."""
        at = np.minimum(np.searchsorted(self.word, words), max(0, len(self.word) - 1))
        return at, self.word[at] == words if len(self.word) else np.zeros(len(words), bool)


class Learnt(NamedTuple):
    head: Head
    tail: DataFrame  # word, n and class (null: rare) of all other training words
    of_class: np.ndarray  # tokens
    tokens: int
    distinct: int
    documents: int
    rare_tokens: int
    rare_distinct: int


def is_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


@tk.lean
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tk.buffers(batch.column(0))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in tk.blocks(offsets):
            held.append(np.unique(tk.words(data, offsets, i, j).hash, return_counts=True))
        if held:
            words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def word_counts(train: DataFrame) -> DataFrame:
    """word (a 64-bit hash) and n over all training texts, as a written table."""
    found = train.select(F.col("text").cast("string")).mapInArrow(_word_counts, "word long, n long")
    return cut(found.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def least_frequent(counts: DataFrame, limit: int) -> int:
    """The smallest count such that at most `limit` words have it or more; from a histogram over fine bins of counts."""
    by_bin = counts.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    bins = by_bin.orderBy(F.desc("bin")).collect()
    total, least = 0, 1 << 62
    for row in bins:  # at most 16 for each power of two
        total += row["words"]
        if total > limit:
            break
        least = row["least"]
    return least


def _with_ends(symbols: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The symbols of a block's texts with an end before the first text and after each."""
    out = np.full(len(symbols) + len(first), end, np.int64)
    out[np.arange(len(symbols)) + 1 + np.repeat(np.arange(len(first) - 1), np.diff(first))] = symbols
    return out


class Bigrams(NamedTuple):
    """Pairs of symbols that occur, ascending, and how often."""

    size: int
    first: np.ndarray
    second: np.ndarray
    n: np.ndarray

    def by_class(self, own: np.ndarray) -> np.ndarray:
        total = int(own.max()) + 1
        return np.bincount(own[self.first] * total + own[self.second], self.n, total * total).reshape(total, total)


def _added(total: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of keys, with more keys counted in."""
    more, n = np.unique(keys, return_counts=True)
    both, back = np.unique(np.concatenate([total[0], more]), return_inverse=True)
    return both, np.bincount(back, np.concatenate([total[1], n]), len(both)).astype(np.int64)


def bigram_counts(train: DataFrame, head: Head, size: int) -> Bigrams:
    """How often each of `size` symbols, numbered as the head's classes are, follows each, over all training texts."""
    sent = train.sparkSession.sparkContext.broadcast(head)

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = sent.value
        for batch in batches:
            total = np.zeros(0, np.int64), np.zeros(0, np.int64)
            data, offsets = tk.buffers(batch.column(0))
            for i, j in tk.blocks(offsets):
                w = tk.words(data, offsets, i, j)
                at, there = head.look_up(w.hash)
                s = np.where(there, head.own[at] if len(head.own) else head.rare, head.rare)
                chain = _with_ends(s, w.first, head.end)
                total = _added(total, chain[:-1] * size + chain[1:])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, total)), names=["pair", "n"])

    pairs = train.select(F.col("text").cast("string")).mapInArrow(run, "pair long, n long")
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = found["pair"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(pair)
    pair = pair[order]
    return Bigrams(size, (pair // size).astype(np.int32), (pair % size).astype(np.int32), n[order].astype(np.float64))


def exchange(bigrams: Bigrams, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each symbol by exchange clustering; the last two symbols keep classes of their own.

    A word leaves its class and joins the one where the log-likelihood, sums of n log n over class bigrams less
    those over class counts, gains most; with C classes a move is weighed by O(C * C) additions."""
    n = bigrams.size - 2
    if n <= 0:
        return np.arange(bigrams.size)
    c = min(classes, n)
    total = c + 2
    own = np.concatenate([np.arange(n) % c, [c, c + 1]])  # symbols come by frequency, so frequent words start apart
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    m = bigrams.by_class(own)
    fm = f(m)  # kept in step with m
    back = np.argsort(bigrams.second, kind="stable")
    lead, lead_n = bigrams.first[back], bigrams.n[back]
    follow_at = np.searchsorted(bigrams.first, np.arange(n + 1))
    lead_at = np.searchsorted(bigrams.second[back], np.arange(n + 1))
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            a, here, there = own[w], slice(*follow_at[w : w + 2]), slice(*lead_at[w : w + 2])
            same = float(bigrams.n[here][bigrams.second[here] == w].sum())
            right = np.bincount(own[bigrams.second[here]], bigrams.n[here], total)
            left = np.bincount(own[lead[there]], lead_n[there], total)
            right[a] -= same
            left[a] -= same
            m[a] -= right
            m[:, a] -= left
            m[a, a] -= same
            fm[a], fm[:, a] = f(m[a]), f(m[:, a])
            out, into = m.sum(1) + left, m.sum(0) + right  # what stays, wherever the word goes
            k, after, before = np.arange(c), np.flatnonzero(right), np.flatnonzero(left)
            gain = (f(m[:c, after] + right[after]) - fm[:c, after]).sum(1)
            gain += (f(m[before, :c] + left[before, None]) - fm[before, :c]).sum(0)
            corner, r, lf = m[k, k], right[:c], left[:c]
            gain += f(corner + r + lf + same) - f(corner) - (f(corner + r) - f(corner)) - (f(corner + lf) - f(corner))
            gain -= f(out[:c] + right.sum() + same) - f(out[:c]) + f(into[:c] + left.sum() + same) - f(into[:c])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            m[b] += right
            m[:, b] += left
            m[b, b] += same
            fm[b], fm[:, b] = f(m[b]), f(m[:, b])
            own[w] = b
            moved += b != a
        if not moved:
            break
    return own


def joining_gains(m: np.ndarray) -> np.ndarray:
    """What a neighbour adds to the likelihood when its word joins a class, to first order.

    Rows: the class of the word after, then of the word before; columns: the classes that words may join. `m` has
    the class bigrams so far."""
    size = len(m)
    after = np.log((m + ADD) / (m.sum(1, keepdims=True) + ADD * size))
    before = np.log((m + ADD) / (m.sum(0, keepdims=True) + ADD * size))
    return np.concatenate([after[: size - 2].T, before[:, : size - 2]])


def _neighbours(sent: Broadcast) -> Callable:
    """word, cell and n: of each word without a class, how often each class stands after and before it."""

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = sent.value
        size = head.end + 1
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            words, cells = [], []
            for i, j in tk.blocks(offsets):
                w = tk.words(data, offsets, i, j)
                at, there = head.look_up(w.hash)
                s = np.where(there, head.own[at] if len(head.own) else head.rare, head.rare)
                chain = _with_ends(s, w.first, head.end)
                place = np.arange(len(s)) + 1 + tk.text_of(w)
                new = s == head.rare
                words += [w.hash[new], w.hash[new]]
                cells += [chain[place[new] + 1], size + chain[place[new] - 1]]
            if words:
                distinct, back = np.unique(np.concatenate(words), return_inverse=True)
                keys, n = np.unique(back * (2 * size) + np.concatenate(cells), return_counts=True)
                columns = [distinct[keys // (2 * size)].view(np.int64), (keys % (2 * size)).astype(np.int32), n]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["word", "cell", "n"])

    return run


def _best_class(gains: np.ndarray) -> Callable:
    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for at in range(0, batch.num_rows, 500):
                part = batch.column("cells").slice(at, 500)
                flat = part.flatten()
                first = part.offsets.to_numpy()[:-1] - part.offsets[0].as_py()
                weighed = gains[flat.field("cell").to_numpy()] * flat.field("n").to_numpy()[:, None]
                best.append(np.add.reduceat(weighed, first).argmax(1))
            if best:
                columns = [batch.column("word"), pa.array(np.concatenate(best).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "class"])

    return run


def joined_classes(train: DataFrame, counts: DataFrame, head: Head, m: np.ndarray, least: int) -> DataFrame:
    """word and class of every word that has none in the head and occurs `least` times or more."""
    sent = train.sparkSession.sparkContext.broadcast(head)
    seen = train.select(F.col("text").cast("string")).mapInArrow(_neighbours(sent), "word long, cell int, n long")
    often = seen.join(counts.filter(F.col("n") >= least).select("word"), "word", "left_semi")
    cells = often.groupBy("word", "cell").agg(F.sum("n").alias("n"))
    lists = cells.groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # a cell for each class at most
    return lists.mapInArrow(_best_class(joining_gains(m)), "word long, class int")


def learn(train: DataFrame, words: int = WORDS, classes: int = CLASSES, head_words: int = HEAD, least: int = LEAST) -> Learnt:
    """Counts and classes of all words of `train`."""
    counts = word_counts(train)
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    documents, lowest = train.count(), least_frequent(counts, head_words)
    frequent = counts.filter(F.col("n") >= lowest).toArrow()
    order = np.argsort(frequent["word"].to_numpy().view(np.uint64))
    word, count = frequent["word"].to_numpy().view(np.uint64)[order], frequent["n"].to_numpy()[order]
    core = np.lexsort((word, -count))[:words]

    symbol = np.full(len(word), len(core), np.int64)  # the core's words by frequency, then all others
    symbol[core] = np.arange(len(core))
    bigrams = bigram_counts(train, Head(word, count, symbol, len(core)), len(core) + 2)
    clusters = exchange(bigrams, classes)
    rare = int(clusters[-2])
    own = clusters[symbol] if len(word) else symbol
    head = Head(word, count, own, rare)
    if rare:
        found = cut(joined_classes(train, counts, head, bigrams.by_class(clusters), least), "word-classes")
        classed = counts.join(found, "word", "left")
        mine = classed.filter((F.col("n") >= lowest) & F.col("class").isNotNull()).select("word", "class").toArrow()
        place, _ = head.look_up(mine["word"].to_numpy().view(np.uint64))
        own[place] = mine["class"].to_numpy()
    else:
        classed = counts.withColumn("class", F.lit(None).cast("int"))
    tail = cut(classed.filter(F.col("n") < lowest), "tail-classes")

    of_class, kinds = np.bincount(own, count, rare + 1), np.bincount(own, minlength=rare + 1)
    for r in tail.groupBy(F.coalesce("class", F.lit(rare)).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        of_class[r["c"]] += r["n"]
        kinds[r["c"]] += r["kinds"]
    tokens, distinct = int(totals["tokens"]) + documents, int(totals["distinct"]) + (documents > 0)
    return Learnt(head, tail, of_class[:rare], tokens, distinct, documents, int(of_class[rare]), int(kinds[rare]))


_CHAINS = (
    "doc_id long, held_out boolean, n_tokens long, head_known long, head_counts double, head_emitted double, "
    "chain binary, tail array<long>"
)


def _chains(sent: Broadcast) -> Callable:
    """Documents as strings of classes, with what their frequent words add; other words' classes are left open."""

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = sent.value
        log_known = np.log10(head.count + 1.0)
        log_emitted = np.where(head.own == head.rare, log_known, np.log10(head.count)) if len(head.word) else log_known
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            known, sizes, sums, tails, strings = [], [], [], [], []
            for i, j in tk.blocks(offsets):
                w = tk.words(data, offsets, i, j)
                at, there = head.look_up(w.hash)
                own = np.full(len(at), OPEN, np.uint8)
                own[there] = head.own[at[there]]
                text, k = tk.text_of(w), j - i
                found = np.bincount(text[there], minlength=k)
                words = np.diff(w.first)
                known.append(np.stack([words + 1, found]))
                sizes.append(words - found)
                sums.append(np.stack([np.bincount(text[there], x[at[there]], k) for x in (log_known, log_emitted)]))
                tails.append(w.hash[~there])
                strings += [own[a:b].tobytes() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            if known:
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tails).view(np.int64)))
                numbers = [*np.concatenate(known, 1).astype(np.int64), *np.concatenate(sums, 1).astype(float)]
                columns = [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, numbers), pa.array(strings, pa.binary()), tail]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _CHAINS.split(", ")])

    return run


def _closed(rare: int) -> Callable:
    """The strings of classes with the open classes put in; what `found` doesn't name is rare."""

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chain, offsets = tk.buffers(batch.column("chain"))
            chain = chain[offsets[0] : offsets[-1]].copy()
            gaps = np.flatnonzero(chain == OPEN)
            chain[gaps] = rare
            found = batch.column("found")
            place = found.flatten()
            if len(place):
                first = np.searchsorted(gaps, offsets[:-1] - offsets[0])
                lists = found.is_valid().to_numpy(zero_copy_only=False)
                sizes = np.where(lists, found.value_lengths().fill_null(0).to_numpy(), 0)
                at = np.repeat(first, sizes) + place.field("k").to_numpy()
                chain[gaps[at]] = place.field("class").to_numpy().astype(np.uint8)
            raw = chain.tobytes()
            ends = (offsets - offsets[0]).tolist()
            strings = [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [*batch.columns[:-2], pa.array(strings, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "chain"])

    return run


def closed_chains(rows: DataFrame, learnt: Learnt) -> DataFrame:
    """A written row for each document: its string of classes, and the sums of its words' counts and emissions."""
    sent = rows.sparkSession.sparkContext.broadcast(learnt.head)
    open_ = cut(rows.mapInArrow(_chains(sent), _CHAINS).withColumn("row", F.monotonically_increasing_id()), "lm-chains")
    met = open_.select("row", F.posexplode("tail").alias("k", "word")).join(learnt.tail, "word")
    classed = F.col("class").isNotNull()
    found = met.groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1.0)).alias("counts"),
        F.sum(F.log10(F.when(classed, F.col("n")).otherwise(F.col("n") + 1.0))).alias("emitted"),
        F.count(F.lit(1)).alias("known"),
        F.collect_list(F.when(classed, F.struct("k", "class"))).alias("found"),
    )
    zero = F.lit(0.0)
    both = open_.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0))).alias("known"),
        (F.col("head_counts") + F.coalesce("counts", zero)).alias("counts"),
        (F.col("head_emitted") + F.coalesce("emitted", zero)).alias("emitted"),
        "chain",
        "found",
    )
    schema = "doc_id long, held_out boolean, n_tokens long, known long, counts double, emitted double, chain binary"
    return cut(both.mapInArrow(_closed(learnt.head.rare), schema), "lm-closed")


def _whole_chain(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a batch's texts with an end before the first and after each, and where each text begins."""
    chain, offsets = tk.buffers(batch.column("chain"))
    first = offsets - offsets[0]
    return _with_ends(chain[offsets[0] : offsets[-1]].astype(np.int64), first, end), first


def transitions(chains: DataFrame, head: Head) -> np.ndarray:
    """How often each class follows each, over documents that aren't held out."""
    size, end = head.end + 1, head.end

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            chain, _ = _whole_chain(batch, end)
            total += np.bincount(chain[:-1] * size + chain[1:], minlength=size * size)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], names=["pair", "n"])

    pairs = chains.filter(~F.col("held_out")).select("chain").mapInArrow(run, "pair long, n long")
    out = np.zeros(size * size)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most one row a pair of classes
        out[r["pair"]] = r["n"]
    return out.reshape(size, size)


def score(docs: DataFrame, held_out: Column | None = None, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every document,
    learning from the documents that aren't held out."""
    held = is_held_out() if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    learnt = learn(rows.filter(~F.col("held_out")), **options)
    chains = closed_chains(rows, learnt)
    n = transitions(chains, learnt.head)
    end, documents, tokens = learnt.head.end, learnt.documents, learnt.tokens
    transition = np.log10((n + ADD) / (n.sum(1, keepdims=True) + ADD * len(n)))
    rare_unit = np.log10(learnt.rare_tokens + learnt.rare_distinct + 1.0)
    unit = np.concatenate([np.log10(np.maximum(learnt.of_class, 1)), [rare_unit, 0.0]])  # what the end needs none of
    base_unit = np.log10(tokens + learnt.distinct + 1.0)
    end_base = np.log10(documents + 1.0) - base_unit

    @tk.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chain, first = _whole_chain(batch, end)
            step = transition[chain[:-1], chain[1:]] - unit[chain[1:]]
            steps = np.add.reduceat(step, first[:-1] + np.arange(batch.num_rows)) if batch.num_rows else np.zeros(0)
            count, known, counts, emitted = (batch.column(k).to_numpy() for k in ("n_tokens", "known", "counts", "emitted"))
            total = steps + emitted
            columns = [
                count, known + (documents > 0), np.full(len(count), tokens, np.int64), counts - (count - 1) * base_unit + end_base,
                total, np.power(10.0, np.minimum(300.0, -total / count)),
            ]
            arrays = [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "perplexity double"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    return chains.mapInArrow(run, schema)
