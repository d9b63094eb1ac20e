"""Phrase collocations and source divergence against plain versions, and the tries that they share."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from upland.llm import divergence, phrases, tries

SCHEMA = "doc_id long, text string, lang string, source string"


def odd_rows(seed=2):
    """Rows with a hot source and a hot pair of words, ties, repeats, nulls, long words and texts, and other scripts."""
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "sun", "sea", "naïve", "ÉTÉ", "日本", "x1", "don't", "zz", "a-b"]
    rows = []
    for i in range(160):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for _ in range(rng.randint(0, 40)))
        lang, source = rng.choice([("en", "hot")] * 4 + [("en", "b"), ("de", "b"), ("de", ""), (None, None), ("", "c")])
        rows.append((i, text, lang, source))
    rows += rows[:7]
    rows += [(900, None, "en", "hot"), (901, "", "fr", "only"), (902, "...!?", "en", None), (903, "hot pair " * 3000, "en", "hot"), (904, "w" * 70000 + " sea sun", "de", "b")]
    rows += [(910 + k, f"rare{k} word", "it", f"s{k}") for k in range(3)]  # no kept term
    return rows


def frame(spark, rows=None):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("n", "term", "range", "trie", "phrase", "piece", "p", "value", "digest", "place", "size")}).repartition(4)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, depth=3, least=10, most=2000, percent=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {}
        for p, a in counts.items():
            if len(p) > 1 and a >= least:
                found[p] = (a, *min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))))
        gone = {q for p, x in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * x[0] >= percent * counts[q := p[i : i + k]]}
        rows_of = sorted((-x[1], -x[0], " ".join(p).encode(), x[3], x[4]) for p, x in found.items() if p not in gone)
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(rows_of[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("depth", "least", "most", "size", "shard"), [(3, 10, 2000, 1 << 23, 1 << 23), (3, 3, 9, 3000, 2000), (4, 2, 2000, 1500, 900), (2, 2, 2000, 900, 500), (5, 2, 1500, 4000, 4000)])
def test_collocations_against_a_plain_count(spark, depth, least, most, size, shard):
    rows = odd_rows()
    got = sorted(map(tuple, phrases.collocations(frame(spark), depth, least, most, size=size, shard=shard).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == plain_collocations(rows, depth, least, most) and got


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(big, big + 7, big + 9), (10**15, 10**15 + 1, 10**15), (7, 9, 11)], "a long, l long, r long")
    got = {r.a: r.s for r in df.select("a", phrases.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()}
    assert got == {a: 10**6 * a * a // (x * y) for a, x, y in [(big, big + 7, big + 9), (10**15, 10**15 + 1, 10**15), (7, 9, 11)]}


def test_nothing_to_mine(spark):
    for rows in ([], [(1, None, None, None)], [(1, "one two", "en", "a")]):
        assert phrases.collocations(frame(spark, rows)).collect() == []


def test_a_piece_leads_with_the_path_to_its_edge():
    shard = pa.table({"text": ["a b c. a b d. a c"] * 3, "lang": ["x"] * 3})
    trie = phrases.Trie(shard)
    pieces = {r: phrases.Piece(data) for r, data in trie.pieces([(b"x", b"a", b"b", b"d"), (b"x", b"b", b"", b"")])}
    assert [p.led for p in pieces.values()] == [[False] * 4, [True, True, True, False], [True, True, False, False]]
    assert pieces[1].count[0].tolist() == [24] and pieces[1].count[1].tolist() == [9, 6] and pieces[1].count[2].tolist() == [6, 3]
    whole = [tuple(r) for b in phrases.merged_nodes(list(pieces.values())[:1], 1) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert ("x", 2, "a b", "b", 6, 24, [9]) in whole and not any(r[2] == "a b d" for r in whole)
    rest = [r for k in (1, 2) for b in phrases.merged_nodes([pieces[k]], 1) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert ("x", 3, "a b d", "b d", 3, 24, [9, 6]) in rest and not any(r[2] in ("a", "a b") for r in rest)


def plain_audit(rows, few=3, ranks=200):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        w = [lower(x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(w)
        docs[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= few]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, x.decode(), -v, i) for part, rows_of in (("pair", pairs), ("term", terms)) for i, (v, x) in enumerate(rows_of, 1)]
    return sorted(out)


@pytest.mark.parametrize(("few", "ranks", "size", "shard"), [(3, 200, 1 << 23, 1 << 23), (1, 4, 2000, 1500), (2, 200, 700, 500)])
def test_audit_against_a_plain_count(spark, few, ranks, size, shard):
    got = sorted(map(tuple, divergence.audit(frame(spark), few, ranks, size, shard).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain_audit(odd_rows(), few, ranks)


def test_blocks_of_terms_and_bands_of_sources():
    """A walk in small blocks streams what one block does."""
    rng = np.random.default_rng(4)
    groups = divergence.Groups(["a"] * 5 + ["b"] * 2, list("pqrstpq"), np.array([0] * 5 + [1] * 2))
    path = [k.to_bytes(4) + f"t{i:03}".encode() for k in (0, 1) for i in range(90)]
    cells = [np.flatnonzero(rng.random(5 if p[3] == 0 else 2) < 0.5) + (0 if p[3] == 0 else 5) for p in path]
    first = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
    t = divergence.Trie(path, np.ones(180, np.int64), first, np.concatenate(cells), rng.integers(1, 50, first[-1]))
    sent = groups, divergence.Totals(rng.integers(1000, 2000, 7), np.array([90, 90]), np.array([9000, 4000]))

    def walked(dense, most):
        sums = {(int(p), int(q)): int(v) for band in divergence.pair_sums(t, sent, dense, most) for p, q, v in zip(*band, strict=True)}
        best = {g: (terms, v.tolist()) for g, terms, v in divergence.best_terms(t, sent, 30, dense)}
        # kept leaves stand in the order of the walk; which they are is what counts
        return sums, best

    assert walked(7, 11) == walked(1 << 20, 1 << 22) and len(walked(7, 11)[0]) == 29


def test_nothing_to_audit(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    got = divergence.audit(frame(spark, [(1, None, "en", "a"), (2, "x y", "en", None)])).collect()
    assert sorted((r.source, r.part, r.item, r.value, r["rank"]) for r in got) == [("", "pair", "a", 0, 1), ("a", "pair", "", 0, 1)]


def test_more_groups_than_a_task_holds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 2)
    with pytest.raises(ValueError, match="groups"):
        divergence.audit(frame(spark))


def test_shares_in_steps_are_exact():
    rng = np.random.default_rng(1)
    count = np.concatenate([rng.integers(0, 10**12, 500), [0, 10**14]])
    for tokens, terms in ((10**15, 12345), (0, 1), (10**14, 10**9)):
        own = count[count <= tokens]  # a group's count of a term is one of its tokens
        assert divergence.share(own, np.int64(tokens), terms).tolist() == [1 + 10**9 * (int(c) + 1) // (tokens + terms) for c in own]


def test_radix_tries_round_trip_and_merge():
    rng = random.Random(3)
    parts = []
    for _ in range(5):
        path = sorted({bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(0, 30))) for _ in range(200)})
        sizes = [rng.randint(1, 4) for _ in path]
        group = np.concatenate([np.sort(rng.sample(range(6), k)) for k in sizes])
        parts.append(divergence.Trie(path, np.array([rng.randint(1, 3) for _ in path]), np.concatenate([[0], np.cumsum(sizes)]), group, np.array([rng.randint(1, 10**12) for _ in group])))
    for p in parts:
        shared = divergence.shared_bytes(p.path).tolist()
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared == [0, *(common(a, b) for a, b in zip(p.path, p.path[1:], strict=False))]
        back = divergence.from_bytes(divergence.to_bytes(p))
        assert back.path == p.path and all((a == b).all() for a, b in zip(back[1:], p[1:], strict=True))
    whole, cells, documents = divergence.merge(parts, 6, 4), Counter(), Counter()
    for p in parts:
        for i, x in enumerate(p.path):
            documents[x] += int(p.documents[i])
            for k in range(int(p.first[i]), int(p.first[i + 1])):
                cells[x, int(p.group[k])] += int(p.count[k])
    assert whole.path == sorted(x for x, n in documents.items() if n >= 4)
    assert {(whole.path[i], int(whole.group[k])): int(whole.count[k]) for i in range(len(whole.path)) for k in range(int(whole.first[i]), int(whole.first[i + 1]))} == {k: n for k, n in cells.items() if documents[k[0]] >= 4}
