"""The main text of web pages, by two passes of rules over their blocks.

A page is cut at block-level tags; a block is the text between two of them. Blocks inside elements that say what they are (``nav``,
``footer``, ``aside``, ``form``, scripts, or a class, id or role that names a menu, advert, notice, reader comments and
the like) are left out of the flow.

First pass, each block on its own. A block of which more than ``max_link_density`` is link text is bad. Of the others, one of
at least ``short`` characters is good if its stop-word density reaches ``high_density`` and bad if it stays below ``low_density``; a short
block, or one between the densities, is open. Inside ``article`` or ``main`` no block is bad for its words alone (lists of names have no
stop words): it is open.

Second pass. An open block takes the label of its nearest decided neighbour of the same article, or of the same
page outside of any; of two equally near ones a good one decides. Without a decided neighbour it is good.

If the good blocks inside ``article`` or ``main`` hold at least half of the good text of a page, the good blocks outside go: the
article is marked, and they are not in it.

The text of a good block has its character references decoded and runs of white space (as ``str.split`` knows it) turned
into one space. Good blocks are joined in page order by one space.

Rows stay where they are: one pass, no shuffle. The parser is linear in the length of a page.

Edge cases. A null or empty html gives an empty text. Unclosed comments, scripts and tags end with the page; tags that are closed
without being open are ignored; very long pages are read whole, and bound the memory of their task only. Equal rows, also with equal or null ids, give
equal rows. Of a tie the second pass states the rule. An empty table gives an empty result; extra columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Frequent words without meaning of their own, in the languages of the pages.
STOP_WORDS = {
    "en": "a about all an and are as at be but by can for from had has have he her his i if in is it its not of on or she so that the their there they this to was we were which who will with you",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von war wie wird zu zum zur",
    "es": "al como con de del el en entre era es esta este fue ha la las lo los más no o para pero por que se sin sobre su sus también un una y ya",
}

# Elements by what HTML says of them.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())  # their text holds no tags
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOT_TEXT = frozenset("nav footer aside form head menu dialog search button select template svg math object canvas audio video noscript script style fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSED_BY_THEMSELVES = frozenset("li dt dd tr td th option".split())  # the next one ends the last
_PARTS = frozenset(["article", "main"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Words in a class or id that name something other than the article.
_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner "
    "sidebar sidenav menu menus navbar nav navigation breadcrumb breadcrumbs topbar masthead footer pagefooter colophon copyright "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending pagination pager widget widgets "
    "comment comments commentlist disqus replies reply respond responses discussion feedback teaser teasers skip disclaimer legal tooltip toast topnav subnav".split()
)
_NEGATIONS = frozenset("no not without has with hide toggle".split())
_HEADER_NAMES = frozenset(["header", "pageheader"])

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # a comment
    r"|<[!?][^>]*>?"  # a declaration
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>",  # a tag and its attributes
    re.S,
)
_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of the first pass: ``short`` in characters, the others as shares of a block's characters or words."""

    short: int = 70
    max_link_density: float = 0.33
    low_density: float = 0.05
    high_density: float = 0.12
    stop_words: frozenset[str] = field(default=frozenset(w for words in STOP_WORDS.values() for w in words.split()))


@dataclass
class Block:
    text: str
    link_chars: int
    part: int  # number of the article or main element, 0 outside of any


def _named(attributes: str, tag: str) -> str:
    """What class, id and role say of an element: ``out`` of the text, a ``header``, or nothing."""
    if not attributes or tag in _PARTS or tag in ("html", "body"):
        return ""
    if _HIDDEN.search(attributes.split("=", 1)[0]):
        return "out"
    found = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return "out"
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "out"
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _NAME_PART.findall(one)]
                if _NEGATIONS.intersection(words):
                    continue
                if _NAMES.intersection(words):
                    return "out"
                if _HEADER_NAMES.intersection(words):
                    found = "header"
    return found


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in its order, without those of elements that say that they are something else."""
    found: list[Block] = []
    pieces: list[str] = []
    links = 0  # characters of link text in the block so far
    stack: list[tuple[str, str]] = []  # open elements and what they do
    open_blocks: list[str] = []  # those of them that are block-level
    opened: dict[str, int] = {}  # how often each is open
    depth = {"out": 0, "header": 0, "heading": 0, "a": 0, "part": 0}
    part, parts = [0], 0

    def end_block() -> None:
        nonlocal pieces, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, links, part[-1]))
        pieces, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if depth["out"] or depth["header"] and not (depth["heading"] and part[-1]):
            return
        text = unescape(raw)
        if depth["a"]:
            links += len(" ".join(text.split()))
        pieces.append(text)

    def close_until(tag: str) -> None:
        while stack:
            name, does = stack.pop()
            opened[name] -= 1
            if name in _BLOCKS:
                open_blocks.pop()
            if does:
                depth[does] -= 1
                if does == "part":
                    part.pop()
            if name == tag:
                return

    at, n = 0, len(html)
    while at < n:
        start = _START.search(html, at)
        upto = start.start() if start else n
        if upto > at:
            add(html[at:upto])
        token = _TOKEN.match(html, upto) if start else None
        if token is None:  # the end, or a tag that the end of the page cuts off
            break
        at = token.end()
        if token.group(1) is None:
            continue
        tag, attributes = token.group(1).lower(), token.group(2)
        is_end = html[token.start() + 1] == "/"
        if tag in _BLOCKS:
            end_block()
        elif tag == "br":
            pieces.append(" ")
        if is_end:
            if opened.get(tag):
                close_until(tag)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else n
            continue
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCKS:
            continue
        if tag in _BLOCKS:
            nearest = open_blocks[-1] if open_blocks else ""
            if nearest == "p" or nearest == tag and tag in _CLOSED_BY_THEMSELVES:
                close_until(nearest)
        elif tag == "a" and opened.get("a"):
            close_until("a")
        does = "out" if tag in _NOT_TEXT else "header" if tag == "header" else _named(attributes, tag)
        if not does:
            does = "heading" if tag in _HEADINGS else "a" if tag == "a" else "part" if tag in _PARTS else ""
        if does == "part":
            parts += 1
            part.append(part[-1] or parts)  # an article inside main belongs to it
        if does:
            depth[does] += 1
        stack.append((tag, does))
        if tag in _BLOCKS:
            open_blocks.append(tag)
        opened[tag] = opened.get(tag, 0) + 1
    end_block()
    return found


def stop_density(text: str, stop_words: frozenset[str]) -> float:
    """The share of stop words among the words (runs of letters) of a text."""
    words = _WORD.findall(text.lower())
    return sum(w in stop_words for w in words) / len(words) if words else 0.0


def label_blocks(blocks: list[Block], rules: BlockRules = BlockRules()) -> np.ndarray:
    """True for each block of a page that belongs to its main text."""
    n = len(blocks)
    if not n:
        return np.zeros(0, bool)
    length = np.array([len(b.text) for b in blocks])
    links = np.array([b.link_chars for b in blocks])
    part = np.array([b.part for b in blocks])
    density = np.array([stop_density(b.text, rules.stop_words) for b in blocks])
    linked = links > rules.max_link_density * length
    long = length >= rules.short
    good = ~linked & long & (density >= rules.high_density)
    bad = linked | long & (density < rules.low_density) & (part == 0)
    for p in np.unique(part):
        own = np.flatnonzero(part == p)
        good[own] = _inherited(good[own], bad[own])
    inside = length[good & (part > 0)].sum()
    if inside and 2 * inside >= length[good].sum():
        good &= part > 0
    return good


def _inherited(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Open blocks with the label of the nearest decided one; a good one if equally near, or if there is none."""
    n = len(good)
    decided = good | bad
    if not decided.any():
        return np.ones(n, bool)
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(decided, place, -1))
    after = np.minimum.accumulate(np.where(decided, place, n)[::-1])[::-1]
    far = 2 * n
    to_before = np.where(before >= 0, place - before, far)
    to_after = np.where(after < n, after - place, far)
    by_before, by_after = good[np.maximum(before, 0)], good[np.minimum(after, n - 1)]
    return np.where(to_before < to_after, by_before, np.where(to_after < to_before, by_after, by_before | by_after))


def main_text(html: str | None, rules: BlockRules = BlockRules()) -> str:
    """The good blocks of a page, joined by one space."""
    blocks = blocks_of(html or "")
    return " ".join(b.text for b, good in zip(blocks, label_blocks(blocks, rules)) if good)


def extract_text(
    pages: DataFrame, rules: BlockRules = BlockRules(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``(id, url, text, n_chars)`` per page."""
    given = pages.select(id_col, url_col, html_col)
    schema = T.StructType([given.schema[0], given.schema[1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = to_arrow_schema(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                texts = [main_text(h, rules) for h in part.column(2).to_pylist()]
                lengths = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), lengths], names)

    return given.mapInArrow(run, schema)


def labelled_blocks(pages: DataFrame, rules: BlockRules = BlockRules(), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per block that is in the flow: id, place, text, densities, whether it is inside an article, and its label."""
    given = pages.select(id_col, html_col)
    kinds = {"place": T.IntegerType(), "text": T.StringType(), "stop_density": T.DoubleType(), "link_density": T.DoubleType(), "in_article": T.BooleanType(), "good": T.BooleanType()}
    schema = T.StructType([given.schema[0], *[T.StructField(c, k) for c, k in kinds.items()]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, html in enumerate(batch.column(1).to_pylist()):
                blocks = blocks_of(html or "")
                labels = label_blocks(blocks, rules)
                columns = [
                    batch.column(0).take(pa.array([at] * len(blocks), pa.int64())),
                    range(len(blocks)),
                    [b.text for b in blocks],
                    [stop_density(b.text, rules.stop_words) for b in blocks],
                    [b.link_chars / len(b.text) for b in blocks],
                    [b.part > 0 for b in blocks],
                    labels.tolist(),
                ]
                yield pa.RecordBatch.from_arrays([columns[0], *[pa.array(list(c), f.type) for c, f in zip(columns[1:], list(arrow)[1:])]], arrow.names)

    return given.mapInArrow(run, schema)
