"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides each block by its own: those in menus,
headers, footers, sidebars, forms and the like, by element, class, id or role, are bad; so are blocks that are
mostly links; blocks with enough stop words are good; short blocks, and those inside an article with few stop
words, are ambiguous. The second pass gives ambiguous blocks the label of the nearest decided block of their
region, and of the two sides at equal distance the good one; where nothing in the region is decided, blocks of
an article are good and others bad. Where that leaves a page without any text, as in a language without stop words in
the list, the region with most text that is neither boilerplate nor links is the text.

Names are no proof: a name that says what the page has, lacks or does (`with-sidebar`, `no-sidebar`,
`share-enabled`) marks nothing, and a marked element that holds most of the page's stop words is text all the
same; one whose whole name is a mark must hold an unmarked article for that, too, and comments never are text.

Null html counts as empty and gives an empty text; a head, a paragraph or a button that isn't closed ends where
the next thing begins; pages cut off within a tag, a script or a character reference are read as far as they go;
repeated rows give repeated results; only page_id, url and html are read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text of the page, to the end of the page if need be (fixed values).
RAW = ("script", "style", "title", "textarea", "iframe")
#: Elements whose content is no text of the page if they are closed (fixed values).
CLOSED = ("noscript", "template", "svg", "object", "audio", "video", "canvas", "annotation", "annotation-xml")
#: The same of those that can't hold one of their own; if they aren't closed, their first run of text (fixed values).
FLAT = ("button", "select")
#: Elements that begin and end a block (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements whose start and end are followed, so that their flags hold for what is in them (fixed values).
CONTAINERS = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol section table td ul".split())
#: Elements that hold no main text (fixed values).
BOILERPLATE = frozenset("aside dialog fieldset footer header menu nav".split())
#: Parts of class and id names, and roles, of what holds no main text (fixed values).
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright dropdown "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted promotion recommended related search share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
    "subscription toolbar widget widgets alert complementary contentinfo form".split()
)
#: The same of reader comments (fixed values).
COMMENTS = frozenset("comment comments discussion disqus replies reply respond".split())
#: Parts of names that tell of a state, not of what is inside (fixed values).
STATES = frozenset(
    "active allowed autoload closed count disabled enabled fixed free has hidden hide is layout no non none not off on open "
    "show sticky visible with without".split()
)
#: Frequent words (fixed values).
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was as with be by are this from or not have an at but his her they which you we he she "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an er so daß dass für sind "
    "le la les de et en un une du que est pour qui dans par sur pas au avec ce il elle se ne aux son "
    "el los las y del por con para su al lo como no más pero sus este ya o fue".split()
)

#: Characters and shares of the first pass.
SHORT, LONG, FEW_STOPS, MANY_STOPS, MANY_LINKS = 70, 200, 0.06, 0.12, 0.33

_OPEN = r"(?=[\s/>])[^>]*"


@functools.lru_cache(1 << len(CLOSED))
def _parts(ended: tuple[str, ...]) -> re.Pattern:
    """What a page consists of; elements of the kinds `ended` go up to their end tags."""
    closed = "|".join(ended) or "(?!)"
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        rf"|<(?P<raw>{'|'.join(RAW)}){_OPEN}(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
        rf"|<(?P<closed>{closed}){_OPEN}(?:/>|>.*?</(?P=closed)\s*>)"
        rf"|<(?P<flat>{'|'.join(FLAT)}){_OPEN}(?:/>|>(?:(?!<(?P=flat)[\s/>]|</?(?:p|div|article|section|main|h\d)[\s>]).)*?</(?P=flat)\s*>|>[^<]*)"
        r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
        r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z|(?=<))"
        r"|<[!?][^>]*(?:>|\Z)|[^<]+|<",
        re.S | re.I,
    )


_END = re.compile(rf"</({'|'.join(CLOSED)})\s*>", re.I)


def parts_of(page: str) -> Iterator[re.Match]:
    """The page's parts in order.

    An element of a kind in CLOSED is sought up to its end tag, but not after the last end tag of its kind, where every
    start would read the rest of the page in vain: so the time is linear in the page, whatever is left open."""
    last = {m[1].lower(): m.start() for m in _END.finditer(page)}
    at = 0
    for edge in (*sorted(set(last.values())), len(page)):
        ended = tuple(sorted(k for k, v in last.items() if v >= at))
        if at > edge:
            continue
        for m in _parts(ended).finditer(page, at):
            if m.start() > edge:
                break
            at = max(m.end(), m.start() + 1)
            yield m


_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")

#: What marks an element: nothing, its kind or invisibility, comments, a whole name, a part of a name.
NONE, HARD, COMMENT, WHOLE, PART = range(5)


class Block(NamedTuple):
    text: str
    linked: int  # characters of links
    bad: bool  # within boilerplate
    article: bool  # within article or main
    region: int


class Frame(NamedTuple):
    """An open container."""

    tag: str
    parent: int
    mark: int


def mark_of(tag: str, more: str) -> int:
    """What marks an element as no main text."""
    if tag in BOILERPLATE:
        return HARD
    best = PART if tag == "form" else NONE
    if not more or tag == "body":
        return best
    for name, value in _ATTRIBUTE.findall(more):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _INVISIBLE.search(value.lower()):
            return HARD
        for token in value.split() if name in ("class", "id", "role") else ():
            parts = [x.lower() for x in _PART.findall(token)]
            if not STATES.isdisjoint(parts):
                continue
            if not COMMENTS.isdisjoint(parts):
                best = min(best or COMMENT, COMMENT)
            elif not HINTS.isdisjoint(parts):
                mark = WHOLE if len(parts) == 1 and tag not in ("article", "main") else PART
                best = min(best or mark, mark)
    return best


def stop_words(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def _bad_frames(frames: list[Frame], raw: list[tuple]) -> list[bool]:
    """Whether each container is boilerplate, by its own mark or an outer one."""
    hard = [False] * len(frames)
    for k, f in enumerate(frames):
        hard[k] = f.mark in (HARD, COMMENT) or f.parent >= 0 and hard[f.parent]
    stops, holds, total = [0] * len(frames), [False] * len(frames), 0
    if any(f.mark in (WHOLE, PART) for f in frames):
        for text, _, frame, _, _ in raw:
            if frame < 0 or not hard[frame]:
                n = stop_words(text)[0]
                total += n
                if frame >= 0:
                    stops[frame] += n
        for k in reversed(range(len(frames))):
            f = frames[k]
            holds[k] |= f.tag in ("article", "main") and f.mark == NONE
            if f.parent >= 0:
                stops[f.parent] += stops[k]
                holds[f.parent] |= holds[k]
    bad = [False] * len(frames)
    for k, f in enumerate(frames):
        most = 2 * stops[k] > total
        own = f.mark in (HARD, COMMENT) or f.mark == PART and not most or f.mark == WHOLE and not (most and holds[k])
        bad[k] = own or f.parent >= 0 and bad[f.parent]
    return bad


def _in_article_header(frames: list[Frame], at: int) -> int:
    """The container around the header that a container is in, if nothing else marks it; else -1."""
    while at >= 0 and frames[at].tag != "header" and frames[at].mark == NONE:
        at = frames[at].parent
    return frames[at].parent if at >= 0 and frames[at].tag == "header" else -1


def blocks_of(page: str) -> list[Block]:
    frames: list[Frame] = []
    raw: list[tuple[str, int, int, bool, int]] = []  # text, characters of links, container, heading, steps so far
    steps: list[int] = []  # a new region: always (-1), or if that container is boilerplate
    parts: list[str] = []
    at, linked, breaks = -1, 0, 0
    link = heading = False

    def flush() -> None:
        nonlocal parts, linked, breaks
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            raw.append((text, linked, at, heading, len(steps)))
        parts, linked, breaks = [], 0, 0

    for m in parts_of(page):
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and len(piece) > 1:
                if parts and (m["raw"] or m["closed"] or m["flat"]):
                    parts.append(" ")
                continue
            if piece.strip():
                breaks = 0
                if link:
                    linked += len(" ".join(piece.split()))
            parts.append(piece)
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                parts.append(" ")
        elif tag == "a":
            link = not m["close"]
        elif tag in BLOCKS:
            flush()
            link = False
            if tag in CONTAINERS:
                if tag not in ("div", "section", "ul", "ol", "dl", "table", "td", "figure"):
                    steps.append(-1)
                if m["close"]:
                    up = at
                    while up >= 0 and frames[up].tag != tag:
                        up = frames[up].parent
                    at = frames[up].parent if up >= 0 else at
                elif not m["more"].endswith("/"):
                    frames.append(Frame(tag, at, mark_of(tag, m["more"])))
                    at = len(frames) - 1
                if tag in ("div", "section") and at >= 0:
                    steps.append(at)
            heading = not m["close"] and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        elif tag in ("img", "input", "button", "select"):
            parts.append(" ")
    flush()

    bad, article = _bad_frames(frames, raw), [False] * len(frames)
    for k, f in enumerate(frames):
        article[k] = f.tag in ("article", "main") or f.parent >= 0 and article[f.parent]
    out: list[Block] = []
    region = seen = 0
    for text, linked, frame, heading, step in raw:
        region += sum(x < 0 or bad[x] for x in steps[seen:step])
        seen = step
        own, inside = frame >= 0 and bad[frame], frame >= 0 and article[frame]
        if own and inside and heading and (outer := _in_article_header(frames, frame)) >= 0:
            own = bad[outer]
        out.append(Block(text, linked, own, inside, region))
    return out


def first_pass(block: Block) -> bool | None:
    """Good, bad, or None where the block alone doesn't tell."""
    if block.bad:
        return False
    size = len(block.text)
    if block.linked > MANY_LINKS * size and not (block.article and size > LONG):
        return False
    if size < SHORT:
        return None
    found, words = stop_words(block.text)
    stops = found / max(1, words)
    if stops >= MANY_STOPS or stops >= FEW_STOPS and size >= LONG:
        return True
    return None if block.article or stops >= FEW_STOPS else False


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided block of their region that isn't boilerplate."""
    n = len(blocks)
    before: list[int] = [-1] * n
    after: list[int] = [-1] * n
    last: dict[int, int] = {}
    for k in range(n):
        before[k] = last.get(blocks[k].region, -1)
        if labels[k] is not None and not blocks[k].bad:
            last[blocks[k].region] = k
    last = {}
    for k in reversed(range(n)):
        after[k] = last.get(blocks[k].region, -1)
        if labels[k] is not None and not blocks[k].bad:
            last[blocks[k].region] = k
    out = []
    for k, label in enumerate(labels):
        if label is None:
            near = sorted((abs(k - i), not labels[i]) for i in (before[k], after[k]) if i >= 0)
            label = not near[0][1] if near else blocks[k].article
        out.append(bool(label))
    return out


def densest(blocks: list[Block]) -> list[bool]:
    """Where no block is main text by its stop words, as in a language that has none in the list: the blocks of the
    region with most text that are neither boilerplate nor links, if one of them is of some length. Bytes of UTF-8 measure
    it, as scripts differ in what a character says."""
    length = [len(b.text.encode()) for b in blocks]
    fit = [not b.bad and b.linked <= MANY_LINKS * len(b.text) for b in blocks]
    size: dict[int, int] = {}
    for b, good, n in zip(blocks, fit, length, strict=True):
        size[b.region] = size.get(b.region, 0) + good * n
    best = max(size, key=lambda r: (size[r], -r), default=-1)
    kept = [good and b.region == best for b, good in zip(blocks, fit, strict=True)]
    return kept if any(good and n >= SHORT for good, n in zip(kept, length, strict=True)) else [False] * len(blocks)


def extract(page: str) -> str:
    """The page's main text, blocks joined by an empty line."""
    blocks = blocks_of(page)
    kept = second_pass(blocks, [first_pass(b) for b in blocks])
    if not any(kept):
        kept = densest(blocks)
    return "\n\n".join(b.text for b, good in zip(blocks, kept, strict=True) if good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) if x else "" for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
