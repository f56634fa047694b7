"""Main text of web pages: the best-scoring contiguous stretch of a page's words and tags.

A page becomes a sequence of tokens: words score above zero, tags below, and one linear scan finds the stretch with the largest
sum. The weights are log-odds counted on labelled pages. A page that marks up exactly one ``article`` or ``main`` element labels
itself: tokens inside are content, those outside are not. The counts are taken over all such pages in Spark. They score the
words of every page, marked or not; inside such an element a word has a bonus besides, as large as the share of the labelled
pages' text that stands inside. Text outside is scored as on any other page. An element that the stretch enters belongs to it.

Elements that a page declares to be something else (by element name, role, class or id: navigation, adverts, forms, comments
and so on) are left out before scoring, and never returned.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import arrow_map, text_bytes

# Content of these is no text.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
_OTHER = {
    "nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "svg", "math", "object", "audio", "video", "canvas",
    "head", "fieldset", "datalist", "label", "map", "search",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_MAIN = {"article", "main"}
_KEEP = {"html", "body", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
# Words in a class or id that say what an element is.
_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc",
    "footer", "foot", "masthead", "topbar", "sidebar", "aside", "widget", "widgets", "related", "recommended", "recommendations",
    "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "alert", "disclaimer", "copyright",
    "comment", "comments", "commentlist", "disqus", "respond", "discussion", "replies", "reply",
}
_WITH = {"has", "with", "no", "without"}
_HEADS = {"header", "site-header", "page-header"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _RAW}
LIMIT = 4.0
#: Weights where no page is labelled.
DEFAULT = {"word": 1.0, "link": -1.0, "in": 2.0, "tag": -1.0, "p": -0.1, "b": -0.1, "i": -0.1, "em": -0.1, "strong": -0.1, "br": -0.1, "h1": -0.2, "h2": -0.2, "h3": -0.2, "a": -0.5}


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


def _is_other(name: str, raw: str, in_main: bool) -> bool:
    """Whether an element declares itself to be no part of the main text."""
    if name in _OTHER:
        return True
    if name == "header" and not in_main:
        return True
    if not raw or name in _KEEP:
        return False
    own = _attributes(raw)
    if not own and "hidden" not in raw:
        return False
    if own.get("aria-hidden", "").lower() == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", raw):
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    if own.get("role", "").lower() in _ROLES:
        return True
    given = f"{own.get('class', '')} {own.get('id', '')}"
    words = {w.lower() for part in given.split() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", part)}
    if name == "article":
        return bool(words & {"comment", "comments", "reply", "ad", "advert", "sponsored"})
    if words & _WITH:  # "has-sidebar" names a layout
        words = set()
    return bool(words & _NAMES) or bool({p.lower() for p in given.split()} & _HEADS and not in_main)


@dataclass
class Page:
    """Tokens of a page. ``kind``: a tag's name, or "word" and "link" for text; text tokens have words and a block number."""

    kinds: list[str] = field(default_factory=list)
    words: list[list[str] | None] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)  # number of the outermost article or main element around it, 0 for none
    glued: list[bool] = field(default_factory=list)  # no white space between this text and the one before
    mains: int = 0


def parse(source: str) -> Page:
    """Tokens outside the elements that declare themselves to be no main text. Damaged and unclosed markup is tolerated."""
    page = Page()
    at, block, links, depth = 0, 0, 0, 0
    skipping, level = "", 0
    open_end = True  # the text before ended with white space, or a block has begun

    def text(piece: str) -> None:
        nonlocal open_end
        piece = html.unescape(piece)
        words = piece.split()
        if words:
            page.kinds.append("link" if links else "word")
            page.words.append(words)
            page.blocks.append(block)
            page.inside.append(page.mains if depth else 0)
            page.glued.append(not open_end and not piece[0].isspace())
            open_end = piece[-1].isspace()
        elif piece:
            open_end = True

    while at < len(source):
        m = _TOKEN.search(source, at)
        if not m:
            if not skipping:
                text(source[at:])
            break
        if not skipping and m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing, raw = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _RAW and not closing:
            end = _CLOSE[name].search(source, at)
            at = end.end() if end else len(source)
            if name not in _INLINE:
                block, open_end = block + 1, True
            continue
        if skipping:
            if name == skipping:
                level += -1 if closing else 0 if name in ("p", "li") else 1
            # What ends an element that was never closed.
            ends = closing and name in ("body", "html", "article", "main") or not closing and name in ("article", "main", "body") and skipping in ("nav", "header", "head", "menu")
            ends = ends or skipping == "p" and name not in _INLINE
            if level <= 0 or ends:
                skipping = ""
                block, open_end = block + 1, True
                if level <= 0 and closing:
                    continue
            else:
                continue
        if not closing and name not in _VOID and _is_other(name, raw, depth > 0):
            if not raw.endswith("/"):
                skipping, level = name, 1
            block, open_end = block + 1, True
            continue
        if name in _MAIN:
            depth = max(0, depth - 1) if closing else depth + 1
            page.mains += not closing and depth == 1
        if name == "a":
            links = 0 if closing else 1
        if name in ("br", "hr", "td", "th", "img", "wbr"):
            open_end = open_end or name != "wbr"
        if name not in _INLINE and name not in ("td", "th"):
            block, open_end, links = block + 1, True, 0
        if not closing:
            page.kinds.append(name)
            page.words.append(None)
            page.blocks.append(block)
            page.inside.append(page.mains if depth else 0)
            page.glued.append(False)
    return page


def label_counts(page: Page) -> Counter:
    """``(kind, inside)`` counts of a page with exactly one main element; empty for others."""
    out: Counter = Counter()
    if page.mains == 1:
        for kind, words, inside in zip(page.kinds, page.words, page.inside):
            if kind not in _MAIN:
                out[kind if words is None or kind == "link" else "word", inside > 0] += len(words) if words else 1
    return out


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all labelled pages: log-odds of inside against outside, words held above zero, tags below.

    Counted per task and summed in Spark; only HTML's own tag names are counted, so a hundred numbers reach the driver.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: Counter = Counter()
            for source in batch.column(0).to_pylist():
                counts.update(label_counts(parse(source.decode("utf-8", "replace"))))
            keys = [k for k in counts if k[0] in _COUNTED]
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())],
                ["kind", "inside", "n"],
            )

        return each

    counted = arrow_map(pages.select(text_bytes(html_col).alias("_html")), make, "kind string, inside boolean, n long")
    found: dict[str, list[int]] = {}
    for kind, inside, n in counted.groupBy("kind", "inside").agg(F.sum("n")).collect():
        found.setdefault(kind, [0, 0])[inside] = n
    if not sum(b for _, b in found.values()):
        return dict(DEFAULT)
    weights = dict(DEFAULT)
    for kind, (out, inn) in found.items():
        odds = max(-LIMIT, min(LIMIT, math.log((inn + 1) / (out + 1))))
        if kind == "word":
            weights[kind] = max(odds, 0.5)
        elif kind == "link":
            weights[kind] = min(max(odds, -LIMIT), weights["word"] / 2)
        else:
            weights[kind] = min(-0.02, odds - LIMIT / 2)
    out, inn = (sum(found.get(kind, [0, 0])[side] for kind in ("word", "link")) for side in (0, 1))
    weights["in"] = max(0.0, min(LIMIT, math.log((inn + 1) / (out + 1))))
    return weights


_COUNTED = {"word", "link", "p", "div", "section", "span", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", *_INLINE}


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """``[start, end)`` of the contiguous run with the largest sum; the earliest and longest of equal ones, empty if none is above zero."""
    best, begin, end, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or run == best and best > 0 and start == begin:
            best, begin, end = run, start, i + 1
    return begin, end


def extract(source: str, weights: dict[str, float]) -> str:
    """The main text of one page, one line per block."""
    page = parse(source)
    scores = []
    for kind, words, inside in zip(page.kinds, page.words, page.inside):
        if words is None:
            scores.append(0.0 if kind in _MAIN else weights.get(kind, weights["tag"]))
        else:
            scores.append((weights[kind] + (weights["in"] if inside else 0.0)) * len(words))
    begin, end = best_stretch(scores)
    if begin < end:  # a block that the stretch enters belongs to it whole
        texts = [k for k in range(begin, end) if page.words[k] is not None]
        first, final = page.blocks[texts[0]], page.blocks[texts[-1]]
        while begin and page.blocks[begin - 1] == first:
            begin -= 1
        while end < len(page.blocks) and page.blocks[end] == final:
            end += 1
        entered = {page.inside[texts[0]], page.inside[texts[-1]]} - {0}  # and so does an article
        while begin and page.inside[begin - 1] in entered:
            begin -= 1
        while end < len(page.inside) and page.inside[end] in entered:
            end += 1
    lines: list[str] = []
    last = None
    for k in range(begin, end):
        words = page.words[k]
        if words is None:
            continue
        joined = " ".join(words)
        if page.blocks[k] == last:
            lines[-1] += joined if page.glued[k] else f" {joined}"
        else:
            lines.append(joined)
        last = page.blocks[k]
    return "\n".join(lines)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars``, one row per input row; ``weights`` are learnt from ``pages`` unless given.

    Null and empty pages, and pages without main text, give an empty text. Repeated rows stay; other columns are not read; an
    empty table gives an empty result. Nothing is dropped or cut for length.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or learn(pages, html_col))
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_bytes(html_col).alias("_html"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:2])

    def make():
        given = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [extract(h.decode("utf-8", "replace"), given) for h in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

        return each

    return arrow_map(source, make, f"{types}, text string, n_chars long")
