"""Operator 2: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Markup that says what it is (scripts, forms,
menus, footers, asides, and elements whose class, id or role names a menu, an advert, a
notice or comments) holds no blocks of the article.

The first pass classifies every other block by link density, length and stop-word density:
good, bad, or undecided where it is short. On a page in a language whose stop words are known,
a longer block without any is a list of names or codes and is undecided too. The second pass
gives undecided blocks the label of their nearest decided neighbours: where both sides agree
that label, else the nearer one's, on a tie good.

Tags article and main are evidence, not a filter. Where at least half of the good words of a
page (without good ones: of the undecided words) stand inside them they are its main region:
in it a block is good or undecided (bad only by its links), and its undecided blocks look for
neighbours in it and are good where none is; outside, only blocks that are long and dense in
stop words are good, the others of MEDIUM words are bad, and undecided blocks look for
neighbours outside and are bad where none is good. Where most good words stand elsewhere (the
article is a teaser) all blocks count alike.

Defined results: a null or empty page has the empty text; a page without a decided block
keeps its undecided ones; unclosed tags end with the page; repeated rows give a row each;
nulls in other columns are kept, extra columns aren't read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: First pass: a link density above LINKS is bad; LONG words are good, and MEDIUM words with a stop-word density of STOPS.
LINKS, LONG, MEDIUM, STOPS = 0.5, 40, 10, 0.15
#: A block with a lower stop-word density than this has none to speak of.
NONE = 0.03

# Tags.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg canvas object math title textarea select".split())
_OUT = frozenset("nav footer aside form button dialog menu figcaption fieldset header head audio video".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul title".split()
)
_MAIN = frozenset(("article", "main"))
_CLOSES_P = _BLOCK - {"html", "head", "body"}

# Words in class, id and role that say that an element isn't of the article.
_HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|disqus|replies|reply|discussion|related|recommend\w*|pagination|pager|widget|toolbar|copyright|legal|disclaimer|search|complementary|contentinfo|dialog)(?:$|[\s_-])",
    re.I,
)

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his in is it its of on or she that the their they this to was were which with you not
    auf aus das dem den der des die ein eine einen er es für im in ist mit nicht sich sie und von war wie zu zum auch bei
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne par pas pour qui que sur un une
    al como con de del el ella en es esta la las lo los más no para pero por que se su un una y""".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)
_WORD = re.compile(r"[^\W_]+")


@cache
def _close(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*>", re.I)


class Block:
    """A block's text, how many of its characters are linked, whether it is inside article or main; its words and their stop-word density."""

    __slots__ = ("linked", "main", "stops", "text", "words")

    def __init__(self, text: str, linked: int, main: bool):
        self.text, self.linked, self.main = text, linked, main
        words = [w.lower() for w in _WORD.findall(text)]
        self.words = len(words)
        self.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order, without what markup itself rules out."""
    out: list[Block] = []
    parts: list[str] = []
    linked = out_depth = main_depth = link_depth = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, ruled out, main

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, main_depth > 0))
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal out_depth, main_depth, link_depth
        name, ruled, main = stack.pop()
        out_depth -= ruled
        main_depth -= main
        link_depth -= name == "a"

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not out_depth:
            text = page[at:end]
            parts.append(text)
            if link_depth:
                linked += len("".join(html.unescape(text).split()))
        if m is None:
            break
        at = m.end()
        name = m.group(2)
        if name is None:
            if m.group().startswith("<![CDATA[") and not out_depth:
                parts.append(m.group()[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m.group(1):
            if name in _BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("body", "html", "article", "main", "td", "th", "table") and name not in ("body", "html", "article", "main", "table", "tr", "tbody", "section", "div"):
                    break
            continue
        if name in _RAW:
            if not m.group().endswith("/>"):
                close = _close(name).search(page, at)
                at = close.end() if close else n
            if name in _BLOCK:
                flush()
            continue
        if name in _BLOCK:
            flush()
            if name in _CLOSES_P:
                while stack and any(s[0] == "p" for s in stack[-4:]) and stack[-1][0] not in _CLOSES_P - {"p"}:
                    last = stack[-1][0]
                    pop()
                    if last == "p":
                        break
            if name in ("li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
                pop()
        elif name == "br":
            parts.append(" ")
        if name in _VOID or m.group().endswith("/>"):
            continue
        attributes = m.group(3)
        ruled = name in _OUT and not (name == "header" and main_depth)
        if attributes and not ruled and name not in ("body", "html", "article", "main"):
            ruled = bool(_HIDDEN.search(attributes)) or any(_HINTS.search(v.strip("\"'")) for _, v in _ATTRIBUTE.findall(attributes))
        stack.append((name, ruled, name in _MAIN))
        out_depth += ruled
        main_depth += name in _MAIN
        link_depth += name == "a"
    flush()
    return out


def first_pass(block: Block, known: bool = True, region: bool = False) -> bool | None:
    """True good, False bad, None undecided; known: the page's language is, region: the page has a main region."""
    if block.linked > LINKS * max(1, len(block.text.replace(" ", ""))):
        return False
    if known and block.stops < NONE:
        return None if block.main or not region or block.words < MEDIUM else False
    if region and not block.main:
        if block.words >= LONG and (block.stops >= STOPS or not known):
            return True
        return False if block.words >= MEDIUM else None
    return True if block.words >= LONG or block.words >= MEDIUM and block.stops >= STOPS else None


def second_pass(labels: list[bool | None]) -> list[bool]:
    """Undecided blocks inherit from their nearest decided neighbours."""
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(n):
        before[i] = i if labels[i] is not None else (before[i - 1] if i else -1)
    for i in range(n - 1, -1, -1):
        after[i] = i if labels[i] is not None else (after[i + 1] if i + 1 < n else n)
    out = []
    for i in range(n):
        a, b = before[i], after[i]
        if a < 0 and b >= n:
            out.append(True)
        elif a < 0 or b >= n:
            out.append(bool(labels[b if a < 0 else a]))
        elif labels[a] == labels[b] or i - a < b - i:
            out.append(bool(labels[a]))
        else:
            out.append(bool(labels[b]) or i - a == b - i)
    return out


def labelled(page: str) -> list[tuple[Block, bool | None, bool]]:
    """The page's blocks with their labels after the first and after the second pass."""
    found = blocks(page)
    words = sum(b.words for b in found)
    known = sum(b.stops * b.words for b in found) >= NONE * words
    plain = [first_pass(b, known) for b in found]
    told = [b for b, label in zip(found, plain, strict=True) if label] or [b for b, label in zip(found, plain, strict=True) if label is None]
    inside = sum(b.words for b in told if b.main)
    region = 0 < inside and 2 * inside >= sum(b.words for b in told)
    first = [first_pass(b, known, region) for b in found]
    last: list[bool] = [False] * len(found)
    for part in ([b.main for b in found], [not b.main for b in found]) if region else ([True] * len(found),):
        own = [k for k, p in enumerate(part) if p]
        some = [first[k] for k in own]
        if region and not any(some):  # without a good block the region's own label holds
            some = [found[k].main if first[k] is None else first[k] for k in own]
        for k, label in zip(own, second_pass(some), strict=True):
            last[k] = label
    return list(zip(found, first, last, strict=True))


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b, _, good in labelled(page) if good) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_undecided (after the first pass) of every row of pages (page_id, url, html)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [labelled(x.as_py() or "") for x in batch.column(2)]
            out = ["\n".join(b.text for b, _, good in page if good) for page in found]
            counts = [[len(t) for t in out], [len(page) for page in found], [sum(first is None for _, first, _ in page) for page in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), *[pa.array(c, pa.int64()) for c in counts]], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_undecided"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, texts, "page_id long, url string, text string, n_chars long, n_blocks long, n_undecided long")
