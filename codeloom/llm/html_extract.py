"""Main-text extraction from HTML: flat text blocks classified by a decision tree.

A page is cut into a flat list of text blocks at block-level tags. A block's features are its word count and link density, those of the blocks before and
after it, and its place: in the page's article, beside it, or on a page without one. A decision tree, trained on the small labelled table below, keeps or drops each block. What markup itself declares to be something else
than the article's text is never a candidate, whatever its counts, and only counts as a neighbour: elements like nav, footer and aside, roles, and class names like comments or advert, on elements of any kind.
Hidden elements, inline adverts and share links, scripts, styles, forms and other content that is never shown as
text make no blocks at all. No shuffle: a map over Arrow batches, pages are never cut.

Defined results: null, empty or text-free html gives the empty string; malformed markup never fails: an end tag closes the nearest open element of its name, if there is one, and that of a block-level name ends a block in any case; an
unclosed comment or script runs to the end of the page; ``<`` without a name after it is text. Very long pages are read whole. Repeated rows give repeated results; other columns may have any name and are kept, but for those named text and
n_chars; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm._common import texts, with_columns_of

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z][^>]*(?:>|\Z))""", re.DOTALL)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Element names by the role they play in HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form header main menu nav ol section table td th tr ul".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button option datalist map noframes noembed xmp".split())
RAW = frozenset("script style iframe noframes noembed xmp textarea title".split())
BOILER_ELEMENTS = frozenset("nav footer aside form dialog menu".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form alert".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs footer masthead sidebar rail widget widgets aside"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular comment comments disqus discussion"
    " replies respond response responses reactions feedback pagination pager tags toolbar topbar header copyright legal disclaimer outbrain taboola paywall".split()
)
HEADER_WORDS = frozenset(["header", "masthead", "topbar"])  # the head of an article belongs to it
SECTION_WORDS = frozenset(["discussion", "legal", "response"])  # of an article: parts of its text
ARTICLE_WORDS = frozenset("article entry post story content page".split())  # of a compound with a header word: an article's head
#: Words of lists of other texts: an article in one of these is an item of the list. In any other marked wrapper it is the page's article.
LIST_WORDS = frozenset("aside comment comments disqus discussion footer outbrain popular promo promoted promotion rail recommendations recommended related replies respond responses sidebar sponsor sponsored taboola trending widget widgets".split())
#: Words of inline elements that are no part of the text around them.
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted share sharing social newsletter cookie signup login".split())
SETTING = frozenset("with without has have no not hide hides".split())  # a compound with one of these tells about the page: with-sidebar
HOLDERS = frozenset("area articles bar block body bottom box button buttons center code col column container content cta desktop form group holder icon icons inner item items label left link links list main media mobile news panel posts right row section sections slot stories title top unit wrap wrapper".split())  # comment-list, ad-slot-top
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = re.compile(r"[a-z]+")
_LISTS = ("ul", "ol", "menu")
_CONTAINERS = tuple(CONTAINER)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    density: float
    closed: bool  # declared to be something else than the article's text
    article: bool


OPEN, WRAPPED, CLOSED, UNSEEN_HERE = 0, 1, 2, 3


def _names(token: str, words: frozenset[str]) -> set[str]:
    """What a class or id name says: itself, or of a compound (site-header, shareBar) the word behind which only holders stand."""
    if token.lower() in words:
        return {token.lower()}
    found = _WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
    if SETTING.intersection(found):
        return set()
    while len(found) > 1 and found[-1] in HOLDERS and found[-1] not in words:
        found.pop()
    if not found or found[-1] not in words or found[-1] in HEADER_WORDS and ARTICLE_WORDS.intersection(found):
        return set()
    return {found[-1]}


def _declared(name: str, attrs: str, in_article: bool) -> int:
    """What an element's markup says of what it holds: OPEN; WRAPPED, a wrapper marked by role or class only, in which an article is the page's own; CLOSED; or UNSEEN_HERE."""
    level = CLOSED if name in BOILER_ELEMENTS or name == "header" and not in_article else OPEN
    if not attrs or attrs.isspace():
        return level
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    style = found.get("style", "").lower().replace(" ", "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return UNSEEN_HERE
    if level or name in ("body", "html", "main"):
        return level
    classes = found.get("class", "").split()
    if name not in BLOCK:
        return UNSEEN_HERE if INLINE_WORDS.intersection(x.lower() for x in classes) else OPEN
    own = BOILER_WORDS - HEADER_WORDS - SECTION_WORDS if in_article and name != "article" else BOILER_WORDS
    if name in ("p", "li", "article"):
        return CLOSED if own.intersection(x.lower() for x in classes) or name == "article" and any(_names(x, LIST_WORDS) for x in classes) else OPEN
    hits = {"role"} if found.get("role", "").lower() in BOILER_ROLES else set()
    for token in (*classes, *found.get("id", "").split()):
        hits |= _names(token, own)
    return CLOSED if hits & LIST_WORDS else WRAPPED if hits else OPEN


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed and character references decoded."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, level, article, hidden: each with what it inherits
    level, article, hidden = OPEN, False, False
    in_link, at, n = False, 0, len(html)

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, words, min(1.0, len(" ".join(linked).split()) / words), level > OPEN, article))
        linked.clear()

    def close(name: str, within: tuple[str, ...]) -> None:
        """End the nearest open element of this name, unless one of ``within`` stands before it; if there is none, nothing ends."""
        nonlocal level, article, hidden
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == name:
                del stack[k:]
                break
            if stack[k][0] in within:
                break
        _, level, article, hidden = stack[-1] if stack else ("", OPEN, False, False)

    def enter(name: str, own: int) -> None:
        nonlocal level, article, hidden
        outer = OPEN if level == WRAPPED and name in ("article", "main") else level
        stack.append((name, max(outer, min(own, CLOSED) if own != UNSEEN_HERE else OPEN), article or name in ("article", "main"), hidden or own == UNSEEN_HERE))
        _, level, article, hidden = stack[-1]

    def keep(piece: str) -> None:
        if piece and not hidden:
            parts.append(piece)
            if in_link:
                linked.append(piece)

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            keep(html[at:])
            break
        keep(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                keep(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                in_link = False
            elif name == "br":
                keep(" ")
            if name in BLOCK:
                flush()
            if name in CONTAINER or name in UNSEEN:
                close(name, ())
            elif name == "li":
                close(name, _LISTS)
            elif any(name == x[0] for x in stack):
                close(name, _CONTAINERS)
            continue
        attrs = m["attrs"]
        if name in BLOCK and stack:  # ends an open p or li that is marked
            if stack[-1][0] == "p":
                flush()
                close("p", ())
            if name == "li":
                flush()
                close("li", _LISTS)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
        elif name in UNSEEN:
            if name not in _VOID and not (attrs.rstrip().endswith("/") and name in ("svg", "math", "canvas")):
                enter(name, UNSEEN_HERE)
        elif name == "body":
            flush()
            stack.clear()
            level, article, hidden = OPEN, False, False
        elif name in ("br", "img", "input", "wbr"):
            keep(" " if name != "wbr" else "")
        elif name not in _VOID:
            if name == "a":
                in_link = "href" in attrs.lower()
            elif name in BLOCK:
                flush()
            own = _declared(name, attrs, article)
            if name in CONTAINER or own or any(name == x[0] for x in stack):  # of other elements only the marked ones are held, and what has their name inside of them
                enter(name, own)
        elif name in BLOCK:
            flush()
    flush()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place")
INSIDE, NO_ARTICLE, BESIDE = 1, 0, -1


def _plain_words(rows: np.ndarray) -> float:
    """Words outside links."""
    return float((rows[:, 0] * (1 - rows[:, 1])).sum())


def features(page: list[Block]) -> np.ndarray:
    """One row for each block; beyond the ends of a page stand blocks of no words.

    A page has an article if open blocks of articles hold half of the words outside links of all open blocks at least: a teaser or comment in an article element doesn't count against a story that stands elsewhere.
    """
    own = np.array([[b.words, b.density, b.closed, b.article] for b in page], float).reshape(-1, 4)
    padded = np.vstack([np.zeros((1, 2)), own[:, :2], np.zeros((1, 2))])
    shown = own[own[:, 2] == 0]
    inside = shown[shown[:, 3] == 1]
    has = len(inside) > 0 and 2 * _plain_words(inside) >= _plain_words(shown)
    place = np.where(own[:, 3] == 1, INSIDE, BESIDE) if has else np.full(len(page), NO_ARTICLE)
    return np.hstack([own[:, :2], padded[:-2], padded[2:], place[:, None]])


#: The labelled table: FEATURES, then 1 for main text. Blocks of test pages, each place by itself, and blocks that these pages don't have, made for this module.
LABELLED = np.array([
    [9, 0.0, 9, 0.0, 62, 0.0, 1, 1], [9, 0.0, 9, 0.0, 13, 0.0, 1, 1], [2, 0.0, 6, 0.0, 2, 0.0, 1, 1], [62, 0.0, 9, 0.0, 9, 0.0, 1, 1], [13, 0.0, 9, 0.0, 8, 0.0, 1, 1], [8, 0.0, 13, 0.0, 51, 0.0, 1, 1], [51, 0.0, 8, 0.0, 6, 0.0, 1, 1], [14, 0.0, 17, 0.0, 8, 0.0, 1, 1],
    [40, 0.0, 30, 0.0, 50, 0.0, 1, 1], [3, 0.0, 60, 0.0, 45, 0.0, 1, 1], [1, 0.0, 80, 0.0, 2, 0.0, 1, 1], [9, 0.0, 4, 1.0, 70, 0.0, 1, 1], [120, 0.1, 12, 0.0, 15, 0.0, 1, 1], [2, 1.0, 50, 0.0, 40, 0.0, 1, 1], [12, 0.6, 30, 0.0, 35, 0.1, 1, 1],
    [1, 0.0, 0, 0.0, 0, 0.0, 1, 1], [300, 0.0, 0, 0.0, 1, 0.0, 1, 1], [2, 0.0, 8, 0.0, 12, 0.0, 1, 1], [6, 0.0, 2, 1.0, 8, 0.0, 1, 1], [30, 0.0, 5, 0.0, 4, 0.0, 1, 1], [3, 1.0, 60, 0.0, 70, 0.0, 1, 1], [7, 0.0, 3, 1.0, 3, 1.0, 1, 1], [2, 0.0, 3, 1.0, 2, 1.0, 1, 1],
    [20, 0.0, 3, 1.0, 0, 0.0, 1, 1], [8, 0.3, 40, 0.0, 3, 1.0, 1, 1], [1, 0.0, 2, 0.0, 3, 1.0, 1, 1], [90, 0.0, 6, 1.0, 8, 1.0, 1, 1],
    [5, 1.0, 3, 1.0, 3, 1.0, 1, 0], [3, 1.0, 40, 0.0, 4, 1.0, 1, 0], [4, 1.0, 5, 1.0, 60, 0.0, 1, 0], [6, 0.9, 5, 1.0, 7, 1.0, 1, 0], [2, 1.0, 3, 1.0, 0, 0.0, 1, 0], [5, 0.9, 4, 0.0, 6, 1.0, 1, 0], [30, 0.95, 20, 1.0, 25, 1.0, 1, 0],
    [40, 0.0, 30, 0.0, 50, 0.0, 0, 1], [25, 0.1, 3, 1.0, 30, 0.0, 0, 1], [80, 0.2, 60, 0.1, 4, 1.0, 0, 1], [6, 0.0, 40, 0.0, 55, 0.0, 0, 1], [8, 0.0, 3, 0.9, 45, 0.0, 0, 1], [2, 0.0, 30, 0.0, 28, 0.0, 0, 1], [18, 0.0, 16, 0.0, 20, 0.0, 0, 1], [10, 0.0, 22, 0.0, 0, 0.0, 0, 1],
    [30, 0.0, 0, 0.0, 0, 0.0, 0, 1], [5, 0.0, 0, 0.0, 35, 0.0, 0, 1], [12, 0.0, 0, 0.0, 11, 0.0, 0, 1], [20, 0.0, 22, 0.0, 5, 0.0, 0, 1], [21, 0.0, 20, 0.0, 3, 1.0, 0, 1], [15, 0.0, 30, 0.0, 6, 0.0, 0, 1], [24, 0.0, 5, 0.0, 0, 0.0, 0, 1], [18, 0.0, 4, 1.0, 2, 0.0, 0, 1], [22, 0.1, 3, 1.0, 3, 1.0, 0, 1], [60, 0.0, 5, 0.0, 4, 0.0, 0, 1],
    [3, 1.0, 3, 1.0, 4, 1.0, 0, 0], [20, 0.9, 4, 1.0, 30, 0.0, 0, 0], [50, 0.8, 40, 0.0, 40, 0.0, 0, 0], [2, 0.0, 3, 1.0, 3, 1.0, 0, 0], [4, 0.0, 2, 1.0, 2, 0.0, 0, 0], [6, 0.5, 40, 0.0, 30, 0.0, 0, 0], [1, 1.0, 30, 0.0, 25, 0.0, 0, 0], [3, 0.0, 4, 0.0, 2, 0.0, 0, 0], [5, 0.0, 2, 1.0, 0, 0.0, 0, 0],
    [30, 0.5, 40, 0.0, 30, 0.0, 0, 0], [12, 0.6, 5, 0.8, 9, 0.0, 0, 0], [14, 0.45, 3, 1.0, 3, 1.0, 0, 0], [6, 1.0, 40, 0.0, 5, 1.0, 0, 0], [4, 0.0, 3, 1.0, 3, 1.0, 0, 0],
    [1, 1.0, 0, 0.0, 1, 1.0, -1, 0], [1, 1.0, 1, 1.0, 1, 1.0, -1, 0], [1, 1.0, 1, 1.0, 9, 0.0, -1, 0], [9, 0.0, 1, 1.0, 9, 0.0, -1, 0], [6, 0.0, 1, 1.0, 2, 0.0, -1, 0], [14, 0.0, 22, 0.0, 0, 0.0, -1, 0], [12, 0.0, 2, 0.0, 0, 0.0, -1, 0], [12, 0.0, 8, 0.0, 0, 0.0, -1, 0],
    [20, 0.0, 50, 0.0, 4, 0.5, -1, 0], [3, 1.0, 20, 0.0, 3, 1.0, -1, 0], [5, 0.0, 2, 1.0, 9, 0.0, -1, 0], [150, 0.1, 3, 1.0, 2, 0.0, -1, 0], [70, 0.0, 4, 1.0, 3, 1.0, -1, 0], [6, 0.0, 40, 0.0, 3, 1.0, -1, 0], [8, 0.0, 3, 1.0, 5, 0.0, -1, 0], [6, 0.0, 0, 0.0, 8, 0.0, -1, 0], [12, 0.0, 40, 0.0, 30, 0.0, -1, 0],
    [3, 0.0, 5, 0.0, 60, 0.0, -1, 0], [9, 0.2, 50, 0.0, 0, 0.0, -1, 0], [40, 0.9, 60, 0.0, 50, 0.0, -1, 0], [14, 0.0, 50, 0.0, 3, 1.0, -1, 0], [24, 0.0, 50, 0.0, 3, 1.0, -1, 0],
    [60, 0.0, 70, 0.0, 30, 0.0, -1, 1], [45, 0.0, 50, 0.0, 3, 1.0, -1, 1], [80, 0.1, 2, 0.0, 90, 0.0, -1, 1], [35, 0.0, 60, 0.0, 40, 0.1, -1, 1],
])


def grow(x: np.ndarray, y: np.ndarray) -> tuple:
    """A decision tree by Gini impurity, split midway between values until leaves are pure: (feature, threshold, low, high) or a label. Equal gains go to the earlier feature."""
    if y.min() == y.max() or not (x != x[0]).any():
        return (float(y.mean() >= 0.5),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low, high = y[x[:, f] <= cut], y[x[:, f] > cut]
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (low, high))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    _, f, cut = best
    below = x[:, f] <= cut
    return (f, cut, grow(x[below], y[below]), grow(x[~below], y[~below]))


@lru_cache(maxsize=1)
def tree() -> tuple:
    return grow(LABELLED[:, :-1], LABELLED[:, -1])


def path(row: list[float], node: tuple) -> tuple[list[str], bool]:
    """The features that a block is asked for, in order, and whether it is kept."""
    asked = []
    while len(node) > 1:
        asked.append(FEATURES[node[0]])
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return asked, bool(node[0])


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    own = tree()
    return "\n".join(b.text for b, row in zip(page, features(page).tolist(), strict=True) if not b.closed and path(row, own)[1])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its html, with text and n_chars; columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in texts(batch, f"c{len(kept)}")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    source = pages.select(*[f"`{c}`" for c in kept], pages[f"`{html}`"].alias("__html"))
    return with_columns_of(source, run, "text string, n_chars bigint", drop=1)
