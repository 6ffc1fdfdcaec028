"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Blocks of elements that say themselves that they are no main
text (menus, footers, forms, comments and the like, by tag, class or id) leave first. Each other block has its word count and link
density, those of the blocks before and after it, and whether it is a heading or inside an article-like element. A decision
tree, grown from the blocks of the small labelled pages below, keeps or drops each; without telling names it decides alone.

Defined results: null and empty pages have the empty text; pages of any length are read whole; unclosed tags, comments and
scripts run to the end of the page; rows are independent, so ties, repeats and empty tables need no rule. Extra
columns stay, output columns replace those of the same name.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is never text of the page.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "select", "button", "option", "canvas", "audio", "video", "object")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that make up the path of a block; others (p, li, td, ...) are often left open and say little.
PATH = frozenset("article main section div nav aside header footer form dialog menu figure blockquote table ul ol dl body".split())
FURNITURE_TAGS = frozenset("nav aside footer form dialog menu".split())
FURNITURE_NAMES = frozenset(
    "ad ads adslot advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer gdpr login menu modal nav navbar navigation newsletter notice "
    "notices notification pagination popup promo promoted related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets alert aside complementary contentinfo".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_NAMES = frozenset("article articlebody content entry main post story body".split())
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _element(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(tag, furniture, article, page header)."""
    names = set()
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            names.update(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))
    if tag in ("body", "main"):  # their names tell of the page's layout, not of their own content
        names = set()
    furniture = tag in FURNITURE_TAGS or bool(names & FURNITURE_NAMES) or "hidden" in names
    header = tag == "header" or bool(names & {"header", "masthead"})
    article = tag in ARTICLE_TAGS or (tag in ("div", "section") and bool(names & ARTICLE_NAMES))
    return tag, furniture, article and not furniture, header


def blocks(html: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, linked words, in article, in furniture, heading) of each non-empty block, in page order."""
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    path: list[tuple[str, bool, bool, bool]] = []
    state = (False, False)
    heading = link = False
    at, size = 0, len(html)

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                inside = len(unescape("".join(linked)).split()) if linked else 0
                words = text.count(" ") + 1
                out.append((text, words, min(inside, words), state[0], state[1], heading))
            parts.clear()
            linked.clear()

    def where() -> tuple[bool, bool]:
        article = furniture = False
        for _, f, a, h in path:
            article = article or a
            furniture = furniture or f or (h and not article)
        return article, furniture

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            if link:
                linked.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
            if link:
                linked.append(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "a":
                link = not closing
                linked.append(" ")
            continue
        if tag in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
                parts.append(" ")
            continue
        close()
        link = False  # an anchor left open ends with its block
        heading = tag in HEADING and not closing
        if tag in PATH:
            if closing:
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] == tag:
                        del path[k:]
                        state = where()
                        break
            elif tag not in VOID:
                path.append(_element(tag, m[3] or m[6] or ""))
                state = where()
    close()
    return out


LEAF = 3
FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "in article", "heading")


def features(page: list[tuple[str, int, int, bool, bool, bool]]) -> list[tuple[float, ...]]:
    """Of blocks outside page furniture: neighbours are neighbours among them."""
    own = [(float(b[1]), b[2] / b[1]) for b in page]
    edge = (0.0, 0.0)
    return [own[i] + (own[i - 1] if i else edge) + (own[i + 1] if i + 1 < len(own) else edge) + (float(b[3]), float(b[5])) for i, b in enumerate(page)]


def candidates(html: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """The blocks of a page that are not page furniture by element or name."""
    return [b for b in blocks(html) if not b[4]]


_SAY = "One sentence that tells what happened in the town on the day before the market was to open again after a long winter and what the people who came there from all over the country said about it when they were asked"


def _p(*words: int) -> str:
    """Paragraphs of so many words each."""
    return "".join(f"<p>{' '.join(_SAY.split()[:n])}</p>" for n in words)


def _d(*words: int) -> str:
    return "".join(f"<div>{' '.join(_SAY.split()[:n])}</div>" for n in words)


def _a(*words: int) -> str:
    """Items of a list, each of them a link of so many words."""
    return "<ul>" + "".join(f"<li><a href=/x>{' '.join(_SAY.split()[:n])}</a></li>" for n in words) + "</ul>"


#: The labelled table: pages and the label, 1 for main text, of each of their blocks that are not furniture by name. Most pages have no telling names.
LABELLED = (
    # Menus, long paragraphs, short ones and captions between them, more links, a closing line.
    (_a(1, 2, 1) + "<h1>The market opens</h1>" + _p(22, 30, 6, 25) + _a(3, 4, 2) + _d(9), "000 1 1111 000 0"),
    (_a(1, 1) + _p(35, 4, 38, 11, 20) + _a(6, 7, 5), "00 11111 000"),
    (_d(3) + _a(2, 2, 2, 1) + _p(24, 3, 2, 28) + _d(12) + _a(1, 1), "0 0000 1111 0 00"),
    ("<h2>Town</h2>" + _p(18, 9, 27, 33) + _a(8, 9, 7) + _d(5), "1 1111 000 0"),
    # A promotion or notice of some length between links; a teaser that is a long link.
    (_a(1, 2) + _d(14) + _a(2, 1) + _p(26, 31, 8, 29) + _a(12, 14) + _d(13), "00 0 00 1111 00 0"),
    (_a(1, 1, 1) + _d(17) + _a(1, 3) + "<h1>A title</h1>" + _p(40, 21) + _a(2, 2), "000 0 00 1 11 00"),
    (_a(15, 18, 13) + _p(28, 5, 24, 30) + _a(16, 12, 19), "000 1111 000"),
    (_d(6, 4) + _a(1, 2, 1, 1) + "<h1>On the day</h1>" + _p(19, 23, 7, 10, 26) + _a(1, 1) + _d(11, 8), "00 0000 1 11111 00 00"),
    # Short lines alone, far from any text.
    (_d(4, 2, 3) + _a(1, 1), "000 00"),
    (_d(2) + _p(34, 36) + _d(3, 7, 2), "0 11 000"),
    # A sentence with a link in it, a linked line between paragraphs.
    (_a(2, 1) + _p(20) + "<p>One sentence that tells what <a href=/x>happened in</a> the town on the day before</p>" + _p(29) + "<p><a href=/x>Read this too</a></p>" + _p(23, 31) + _a(3, 2), "00 1 1 1 1 11 00"),
    # Articles by element: all of their lines, however short, but not the lists of links at their end.
    ("<article><h1>The market opens</h1>" + _p(22, 3, 25, 1, 2, 6, 4) + "</article>" + _d(10) + _a(2, 2), "1 1111111 0 00"),
    (_d(3) + "<article>" + _p(1, 2, 30, 3) + "<p><a href=/x>Read this</a></p>" + _p(12, 1) + "</article>" + _d(16), "0 1111 1 11 0"),
    ("<article>" + _p(14, 2, 27) + _a(4, 5, 3, 6) + "</article>" + _d(2), "111 0000 0"),
    ("<main>" + _p(5, 4, 3) + "<h2>Town</h2>" + _p(6, 21) + _a(7, 9, 8) + "</main>", "111 1 11 000"),
    ("<article><p>One</p></article>" + _d(4), "1 0"),
    ("<article><h1>The market</h1>" + _p(2, 1, 3) + "</article>" + _a(1, 1) + _d(18), "1 111 00 0"),
)


def composed(pages: int = 80, seed: int = 1) -> list[tuple[str, str]]:
    """More labelled pages by rule: menus, notices between links, a body with short lines between long ones and now and then a linked
    one, lists of links, a closing line; every second body is an article by element and may begin, end or consist of short lines."""
    rng, out = random.Random(seed), []
    for n in range(pages):
        article = n % 2
        links = lambda most: _a(*(rng.randint(1, most) for _ in range(rng.randint(2, 6))))
        line = lambda words: f"<p>{' '.join(_SAY.split()[:words])}</p>"
        before = [(links(4), 0)] if rng.random() < 0.8 else []
        if rng.random() < 0.5:
            before += [(_d(rng.randint(8, 20)), 0), (links(3), 0)]
        body = [("<h1>The market opens</h1>", 1)] if rng.random() < 0.5 else []
        for _ in range(rng.randint(1, 5)):
            if article and rng.random() < 0.3:
                body.append((line(rng.randint(1, 12)), 1))
            else:
                body.append((line(rng.randint(14, 41)), 1))
                between = rng.random()
                if between < 0.4:
                    body.append((line(rng.randint(2, 12)), 1))
                elif between < 0.55:
                    body.append(("<p><a href=/x>Read this too</a></p>", 1))
                if between < 0.55:
                    body.append((line(rng.randint(1 if article else 14, 41)), 1))
        inner = [(links(rng.choice((4, 16))), 0)] if rng.random() < 0.4 else []
        after = [(links(rng.choice((3, 16))), 0)] if rng.random() < 0.7 else []
        if rng.random() < 0.6:
            after.append((_d(rng.randint(2, 13)), 0))
        parts = [*before, *([("<article>", None)] if article else []), *body, *inner, *([("</article>", None)] if article else []), *after]
        labels = "".join(str(y) * len(candidates(x)) for x, y in parts if y is not None)
        out.append(("".join(x for x, _ in parts), labels))
    return out


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = 8) -> tuple | float:
    """CART with Gini impurity: (feature, threshold, below or at, above), or the share of main text in a leaf of LEAF blocks or more."""
    share = sum(y for _, y in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share

    def gini(part: list) -> float:
        p = sum(y for _, y in part) / len(part)
        return 2 * p * (1 - p) * len(part)

    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            below, above = [r for r in rows if r[0][f] <= cut], [r for r in rows if r[0][f] > cut]
            if min(len(below), len(above)) < LEAF:
                continue
            score = gini(below) + gini(above)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut, below, above)
    if best is None or best[0] >= gini(rows) - 1e-12:
        return share
    return (best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1))


def verdict(tree: tuple | float, x: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


@lru_cache(maxsize=4)
def train(labelled=LABELLED) -> tuple | float:
    rows = []
    for html, labels in (*labelled, *composed()):
        found, labels = features(candidates(html)), labels.replace(" ", "")
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {html[:60]}")
        rows += zip(found, map(int, labels))
    return grow(rows)


def main_text(html: str, tree: tuple | float) -> str:
    page = candidates(html)
    return " ".join(b[0] for b, x in zip(page, features(page)) if verdict(tree, x))


def extract(pages: DataFrame, html: str = "html", labelled=LABELLED) -> DataFrame:
    """pages plus text and n_chars (long)."""
    tree = train(labelled)

    def make():
        from stratum.llm.htmltext import main_text

        def run(texts: list[str]) -> list[list]:
            out = [main_text(t, tree) for t in texts]
            return [out, [len(t) for t in out]]

        return run

    return map_texts(pages, html, [("text", T.StringType(), pa.string()), ("n_chars", T.LongType(), pa.int64())], make)
