"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser
reads and evaluates the and/or/with expressions that follow a tag or join phrases.

A text is lower-cased (A-Z only) and cut into words of digits, letters and non-ASCII characters. Phrases
match whole consecutive words. Null and empty texts have no words and no labels; repeated rows give repeated
results; only doc_id and text are read, so further columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of the contract's base labels (fixed values).
BASE = {
    "mit": ["mit license"],
    "apache": ["apache license"],
    "gpl": ["general public license"],
}

#: Notice phrases of further labels (fixed values).
NOTICES = {
    "agpl": ["affero general public license"],
    "all-rights-reserved": ["all rights reserved"],
    "apache-2.0": ["apache license version 2 0", "apache license 2 0", "www apache org licenses license 2 0"],
    "artistic-2.0": ["artistic license 2 0"],
    "bsd": ["bsd license", "redistribution and use in source and binary forms"],
    "bsd-2-clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd license"],
    "bsd-3-clause": ["bsd 3 clause", "3 clause bsd", "new bsd license"],
    "bsl-1.0": ["boost software license"],
    "cc-by-3.0": ["cc by 3 0", "creative commons attribution 3 0"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution 4 0"],
    "cc-by-nc-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0"],
    "cc-by-nc-nd-4.0": ["cc by nc nd 4 0"],
    "cc-by-nc-sa-4.0": ["cc by nc sa 4 0"],
    "cc-by-nd-4.0": ["cc by nd 4 0"],
    "cc-by-sa-3.0": ["cc by sa 3 0"],
    "cc-by-sa-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0"],
    "cc0-1.0": ["cc0 1 0", "creative commons zero"],
    "epl": ["eclipse public license"],
    "gpl-2.0": ["general public license version 2", "general public license v2", "gnu gpl v2"],
    "gpl-3.0": ["general public license version 3", "general public license v3", "gnu gpl v3"],
    "isc": ["isc license"],
    "lgpl": ["lesser general public license", "library general public license"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy"],
    "mpl-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0"],
    "unlicense": ["free and unencumbered software released into the public domain"],
    "zlib": ["zlib license"],
}

#: Identifier tags, as words; an expression follows the tag's colon (fixed values).
TAGS = ["spdx license identifier", "license expression", "licence expression"]

#: Identifiers that an expression may name beside the labels above (fixed values).
IDENTIFIERS = {
    "0bsd", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "apache-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-2.0+", "gpl-3.0-only",
    "gpl-3.0-or-later", "gpl-3.0+", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later",
    "epl-2.0", "python-2.0", "ofl-1.1", "wtfpl", "classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "linux-syscall-note", "font-exception-2.0",
}

#: What the default policy permits: licences, and exceptions that lift a licence's terms (fixed values).
PERMITTED = {"0bsd", "apache", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-3.0", "cc-by-4.0", "cc0-1.0", "isc", "mit", "python-2.0", "unlicense", "zlib"}
LIFTING = {"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception"}

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permitted boolean"

_BIND = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
_TAG = re.compile(r"(?:spdx-license-identifier|licen[sc]e[- ]expression)\s*[:=]\s*([^\n]*)")
_CUT = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_JOINERS = {"the", "a", "an", "either", "both", "of"}


def known(name: str) -> bool:
    return name in NOTICES or name in BASE or name in IDENTIFIERS or name.startswith("licenseref-")


def parse(text: str) -> list[str]:
    """The expression at the start of `text`, in postfix order; it ends where the grammar or the identifiers do.

    An operator with no operand after it, and an unclosed bracket, are dropped."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # whether an operand is due
    for token in _TOKEN.findall(text.lower()):
        token = token.rstrip(".:") if token not in "()" else token
        if operand:
            if token == "(":
                held.append(token)
            elif known(token):
                out.append(token)
                operand = False
            else:
                break
        elif token in _BIND:
            while held and held[-1] != "(" and _BIND[held[-1]] >= _BIND[token]:
                out.append(held.pop())
            held.append(token)
            operand = True
        elif token == ")" and "(" in held:
            while (top := held.pop()) != "(":
                out.append(top)
        else:
            break
    if operand:  # after an operator, or at an opening bracket, nothing came
        while held and (held[-1] == "(" or operand):
            operand &= held[-1] == "("
            held.pop()
    out += [x for x in reversed(held) if x != "("]
    return out


def evaluate(postfix: list[str], permitted: set[str] = PERMITTED, lifting: set[str] = LIFTING) -> bool | None:
    """Whether a use that permits `permitted` may take the work; None without an expression."""
    stack: list[tuple[bool, str]] = []
    for token in postfix:
        if token in _BIND:
            (right, name), (left, _) = stack.pop(), stack.pop()
            stack.append(({"or": left or right, "and": left and right, "with": left or name in lifting}[token], ""))
        else:
            stack.append((token in permitted, token))
    return stack[-1][0] if stack else None


def written(postfix: list[str]) -> str:
    """The expression with all brackets."""
    stack: list[str] = []
    for token in postfix:
        if token in _BIND:
            right, left = stack.pop(), stack.pop()
            stack.append(f"({left} {token.upper()} {right})")
        else:
            stack.append(token)
    return stack[-1] if stack else ""


@cache
def automaton():
    """All phrases and tags, as words between single spaces."""
    import ahocorasick

    found: dict[str, list[tuple[str, bool]]] = {}
    for labels, base in ((BASE, True), (NOTICES, False)):
        for label, phrases in labels.items():
            for phrase in phrases:
                found.setdefault(phrase, []).append((label, base))
    for tag in TAGS:
        found.setdefault(tag, []).append(("", False))
    out = ahocorasick.Automaton()
    for phrase, labels in found.items():
        out.add_word(f" {phrase} ", (len(phrase), phrase.count(" ") + 1, labels))
    out.make_automaton()
    return out


def scan(raw: bytes) -> tuple:
    """A text's row without its id, as in RESULT."""
    words = raw.translate(_CUT).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, "", None
    line = " " + b" ".join(words).decode("latin-1") + " "
    hits = [(end - 1 - size, n, labels) for end, (size, n, labels) in automaton().iter(line)]
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, "", None
    places, at, k = [], 0, 0
    for start, n, labels in sorted(hits, key=lambda h: h[:2]):
        k += line.count(" ", at, start)  # a space stands before each word, so these are the words before the phrase
        at = start
        places.append((k, n, labels))
    base = [k for k, _, labels in places for label, is_base in labels if is_base]
    base_labels = {label for _, _, labels in places for label, is_base in labels if is_base}
    labels = {label for _, _, labels in places for label, _ in labels if label}
    score = max((1 - 0.5 ** (n / 2) for _, n, ls in places if any(label for label, _ in ls)), default=0.0)
    expressions = []
    if any(label == "" for _, _, ls in places for label, _ in ls):
        for rest in _TAG.findall(raw.decode("utf-8", "replace").lower()):
            if postfix := parse(rest):
                expressions.append(postfix)
                labels |= {x for x in postfix if x not in _BIND}
                score = 1.0
    expressions += joined(places, words)
    verdicts = [evaluate(p) for p in expressions]
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, ";".join(map(written, expressions)), all(verdicts) if verdicts else None


def joined(places: list[tuple[int, int, list]], words: list[bytes]) -> list[list[str]]:
    """Expressions of neighbouring phrases: one licence each, or several with a lone "and" or "or" between."""
    best: list[tuple[int, int, str]] = []  # of overlapping phrases the longest, by place
    for k, n, labels in places:
        name = min((label for label, _ in labels if label), default="")
        if not name:
            continue
        if best and k < best[-1][1]:
            if k + n - best[-1][0] > best[-1][1] - best[-1][0] or k + n > best[-1][1]:
                best[-1] = (min(k, best[-1][0]), max(k + n, best[-1][1]), name)
            continue
        best.append((k, k + n, name))
    out: list[list[str]] = []
    end = None
    for k, stop, name in best:
        between = [w.decode("utf-8", "replace") for w in words[end:k]] if end is not None and k - end <= 4 else []
        links = [w for w in between if w in ("and", "or")]
        if out and len(links) == 1 and all(w in _JOINERS for w in between if w not in ("and", "or")):
            left = out[-1]
            out[-1] = [*left[:-1], name, "and", "or"] if links[0] == "and" and left[-1] == "or" else [*left, name, links[0]]
        else:
            out.append([name])
        end = stop
    return out


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row per document; a map over Arrow batches without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.string()), ("permitted", pa.bool_())])
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [scan(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column("text")]
            columns = [batch.column("doc_id"), *map(list, zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
