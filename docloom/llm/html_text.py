"""Main text of web pages: flat text blocks, classified by a decision tree over words, link density and neighbours.

A page becomes a flat list of blocks. Each has its word count and link density, those of the blocks before and after,
whether it is a heading, and where it stands: in an article (2), in the main part (1), elsewhere (0), and whether in
something around the text (menu, form, advert, notice, comments). What a wrapper's element or class says does not hold
for a wrapper of the page's own article, nor for one with the top heading and over a third of the page's words. A CART tree
trained on the small labelled table below, whose pages cross lengths and positions, keeps or drops each block.

Defined results: null, empty and text-free pages give an empty text; unclosed and cut-off tags, comments and scripts
end at the page's end; repeated rows are extracted row by row; other columns go through whole.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import long, packed, table, text_map

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
#: Elements whose text is never shown as running text.
HIDDEN = frozenset("script style title noscript template iframe object svg math canvas audio video select option button textarea datalist".split())
BLOCKS = frozenset("html head body main article section div nav header footer aside form fieldset menu dialog p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hr center".split())
AROUND = frozenset("nav footer aside form fieldset menu dialog".split())
#: An element that opens ends an open one of its own list, up to the element in second place.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Class and id words of what stands around a text (fixed values); ad-slot, ad_top and the like count by their first part.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar share sharing social related recommend recommended recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager widget widgets hidden copyright disclaimer".split())
COMMENT_HINTS = frozenset("comment comments reply replies disqus respond".split())
HEADER_HINTS = frozenset("header head".split())
MAIN_HINTS = frozenset("article articlebody post entry story content main".split())
#: First parts of class words that describe a wrapper by what it holds or lacks (fixed values).
STATES = frozenset("has no with without is not show hide layout page body single type category tag format js".split())
ROLES_AROUND = frozenset("navigation banner complementary contentinfo search form dialog alert menu".split())
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?", re.I)
FEATURES = ["words", "link_density", "words_before", "density_before", "words_after", "density_after", "place", "around", "page_has", "heading"]
#: What an element is, as bits. A WEAK one can be a wrapper; a FIRM one is always around the text.
ARTICLE, MAIN, WEAK, FIRM, HEADER = 1, 2, 4, 8, 16


def _hinted(names: str, tag: str) -> int:
    out = 0
    for name in names.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        if not parts or parts[0] in STATES and len(parts) > 1:
            continue
        ends = {parts[0], parts[-1]}
        if ends & COMMENT_HINTS:
            out |= FIRM if tag != "body" else 0
        elif tag in ("article", "main"):  # their other class words say what they look like
            out |= WEAK * (parts[0] in ("ad", "ads", "advert", "sponsored", "promo", "related"))
        elif ends & HINTS:
            out |= WEAK
        elif ends & HEADER_HINTS:
            out |= HEADER  # around, unless inside an article
        elif tag in ("div", "section", "td") and ends & MAIN_HINTS:
            out |= MAIN
    return out


def _marks(tag: str, attributes: str) -> int:
    """What an element's tag and attributes say of it."""
    out = {"article": ARTICLE, "main": MAIN, "form": WEAK, "fieldset": WEAK, "header": HEADER}.get(tag, FIRM if tag in AROUND else 0)
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name in ("class", "id"):
                out |= _hinted(value, tag) if tag != "html" else 0
            elif name == "role":
                out |= MAIN * (value == "main") | ARTICLE * (value == "article") | WEAK * (value in ROLES_AROUND)
            elif name == "itemprop":
                out |= ARTICLE * (value == "articlebody") | FIRM * (value == "comment")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                out |= FIRM
    return out


class Elements:
    """The elements of a page that hold blocks: parent, marks, words inside, whether a top heading is inside."""

    def __init__(self):
        self.parent, self.marks, self.words, self.title = [-1], [0], [0], [False]

    def add(self, parent: int, marks: int, title: bool) -> int:
        self.parent.append(parent)
        self.marks.append(marks)
        self.words.append(0)
        self.title.append(title)
        return len(self.marks) - 1

    def places(self) -> list[tuple[int, bool]]:
        """(place, around) of each element."""
        n, words, title = len(self.marks), list(self.words), list(self.title)
        for k in range(n - 1, 0, -1):
            if not self.marks[k] & FIRM:
                words[self.parent[k]] += words[k]
                title[self.parent[k]] |= title[k]
        # the page's own article: the largest article that nothing firm is around, or else the largest main part
        firm = [False] * n
        best: dict[int, tuple[int, int]] = {}
        for k in range(1, n):
            firm[k] = firm[self.parent[k]] or bool(self.marks[k] & FIRM)
            for kind in (ARTICLE, MAIN):
                if self.marks[k] & kind and not firm[k] and words[k] > best.get(kind, (0, 0))[0]:
                    best[kind] = (words[k], k)
        k = best.get(ARTICLE, best.get(MAIN, (0, 0)))[1]
        wraps = set()
        while k:
            wraps.add(k)
            k = self.parent[k]
        out = [(0, False)]
        for k in range(1, n):
            place, around = out[self.parent[k]]
            m = self.marks[k]
            wrapper = title[k] and 3 * words[k] > words[0]
            around = around or bool(m & FIRM) or bool(m & WEAK) and not (wrapper or k in wraps) or bool(m & HEADER) and not (place or wrapper)
            out.append((2 if m & ARTICLE else max(place, 1) if m & MAIN else place, around))
        return out


def blocks(page: str) -> list[tuple[str, int, int, int, bool, bool]]:
    """(text, words, linked words, place, around, heading) of each block with text, in page order."""
    out: list[tuple[str, int, int, int, bool]] = []
    elements = Elements()
    stack: list[tuple[str, int]] = []  # tag and element
    text: list[str] = []
    linked: list[str] = []
    link = heading = 0

    def flush():
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                n = whole.count(" ") + 1
                at = stack[-1][1] if stack else 0
                elements.words[at] += n
                out.append((whole, n, min(n, len(html.unescape(" ".join(linked)).split())), at, bool(heading)))
        text.clear()
        linked.clear()

    def put(s: str):
        text.append(s)
        if link:
            linked.append(s)

    at = 0
    low = None
    while True:
        m = TAG.search(page, at)
        if m is None:
            if at < len(page):
                put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                put(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in HIDDEN:
            if not closing and not attributes.endswith("/"):
                low = page.lower() if low is None else low
                low = low if len(low) == len(page) else re.sub("[A-Z]", lambda x: x[0].lower(), page)
                end = low.find(f"</{tag}", at)
                if end < 0 and tag in ("option", "select", "button", "svg", "math", "object", "canvas", "audio", "video"):
                    continue
                at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            link = 0 if closing else 1
        elif tag in BLOCKS:
            flush()
            link = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    stack.pop()
                if tag in ENDS:
                    same, until = ENDS[tag]
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in until:
                            break
                        if stack[k][0] in same:
                            del stack[k:]
                            break
                if tag != "hr":
                    stack.append((tag, elements.add(stack[-1][1] if stack else 0, _marks(tag, attributes), tag == "h1")))
            heading = bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    places = elements.places()
    return [(t, n, k, *places[e], h) for t, n, k, e, h in out]


def features(found: list[tuple]) -> np.ndarray:
    n = np.array([[b[1], b[2] / b[1], b[3], b[4], b[5]] for b in found], float).reshape(len(found), 5)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, n[:-1, :2]]), np.vstack([n[1:, :2], edge])
    has = np.full((len(n), 1), float((n[:, 2] * (1 - n[:, 3])).max()) if len(n) else 0)
    return np.hstack([n[:, :2], before, after, n[:, 2:4], has, n[:, 4:]])


#: Words of a labelled paragraph, heading or list item, and of what is around a text.
LENGTHS, SHORT = (1, 2, 4, 8, 15, 30, 60, 110, 200, 400, 700), (1, 2, 3, 5, 8, 12, 20, 40, 90)
#: Kinds of labelled pages: where the text stands, and whether its own marks tell what is around it.
PAGES = [("article", True), ("article", False), ("main", True), ("main", False), ("none", True), ("none", False)]


def labelled_pages(seed: int = 3, each: int = 80) -> list[list[tuple]]:
    """The labelled table: pages as lists of (words, linked words, place, around, heading, keep).

    Texts of 1 to 20 paragraphs of all LENGTHS in any order, with headings, lists and links; before, between and after
    them menus, notices, adverts, forms, comments and closing lines.
    """
    r = random.Random(seed)
    out = []
    for kind, marked in PAGES:
        place = {"article": 2, "main": 1, "none": 0}[kind]
        for _ in range(each):
            page: list[tuple] = []
            bare = r.random() < 0.4  # nothing but the text

            def menu(around: bool, n: int):
                for _ in range(n):
                    k = r.randint(1, 6)
                    page.append((k, k, 0, around, False, 0))

            menu(marked, 0 if bare else r.randint(0, 8))
            if r.random() < 0.5 and marked and not bare:  # a slogan or a notice
                page.append((r.choice(SHORT), 0, 0, True, False, 0))
            if r.random() < 0.3 and kind != "none" and not bare:  # short lines outside the text, without marks
                page.append((r.choice(SHORT[:6]), 0, 0, False, False, 0))
            if r.random() < 0.8:
                page.append((r.randint(2, 14), 0, place, False, True, 1))
            for _ in range(r.choice([1, 1, 2, 3, 5, 10, 20])):
                n = r.choice(LENGTHS)
                links = r.choice([0, 0, 0, r.randint(0, n // 3)]) if place or n > 8 else 0
                page.append((n, links, place, False, False, 1))
                if r.random() < 0.15:
                    page.append((r.randint(1, 12), 0, place, False, True, 1))
                if r.random() < 0.1:  # a list, some of links within the text
                    for _ in range(r.randint(2, 5)):
                        k = r.randint(1, 9)
                        page.append((k, k if place and r.random() < 0.3 else 0, place, False, False, 1))
                if r.random() < 0.15 and marked:  # an advert, a form, a share bar
                    k = r.choice(SHORT)
                    page.append((k, r.choice([0, k]), place, True, False, 0))
            if marked and not bare:  # comments
                for _ in range(r.choice([0, 0, 2, 5])):
                    page.append((r.choice(LENGTHS), 0, place, True, r.random() < 0.1, 0))
            for _ in range(0 if bare else r.randint(0, 5)):  # related links and the closing menu
                k = r.randint(2, 10)
                page.append((k, k, 0, marked, False, 0))
            if not bare and r.random() < 0.7 and (marked or kind != "none"):
                page.append((r.choice(SHORT[:7]), 0, 0, marked, False, 0))
            out.append(page)
    return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES of the labelled blocks, and 1 for those to keep."""
    pages = labelled_pages()
    return np.vstack([features([("", *b[:5]) for b in p]) for p in pages]), np.array([b[5] for p in pages for b in p], float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 8):
    """A CART tree by Gini impurity: a share of kept blocks, or (feature, threshold, below, at or above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (1e-9, None)
    parent = len(y) * 2 * share * (1 - share)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, k] < t
            a, b = y[low], y[~low]
            if min(len(a), len(b)) >= least:
                gain = parent - sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in (a, b))
                if gain > best[0] + 1e-9:
                    best = (gain, (k, float(t)))
    if best[1] is None:
        return share
    k, t = best[1]
    low = x[:, k] < t
    return (k, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def keep(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    k, t, below, above = tree
    low = x[:, k] < t
    out = np.empty(len(x), bool)
    out[low], out[~low] = keep(below, x[low]), keep(above, x[~low])
    return out


@lru_cache(1)
def default_tree():
    return grow(*labelled_table())


def main_text(page: str, tree=None) -> str:
    found = blocks(page)
    if not found:
        return ""
    kept = keep(default_tree() if tree is None else tree, features(found))
    return "\n".join(b[0] for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, markup: str = "html", labelled: list[tuple] | None = None) -> DataFrame:
    """(_row, text, n_chars) for every row of pages. labelled: rows of FEATURES and 1 for blocks to keep, to train on instead."""
    tree = default_tree() if labelled is None else grow(np.array(labelled, float)[:, :-1], np.array(labelled, float)[:, -1])

    def make():
        def columns(texts: list[str]) -> list[list]:
            out = [main_text(t, tree) for t in texts]
            return [out, list(map(len, out))]

        return columns

    return text_map(packed(pages, markup), make, [T.StructField("text", T.StringType()), long("n_chars")], rows=256)


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select(F.col("_row.page_id").alias("page_id"), F.col("_row.url").alias("url"), "text", "n_chars")
