"""Main text of HTML pages from flat text blocks.

A page becomes a flat list of blocks with word count and link density. Elements such as ``div`` or ``article`` cut the
list into containers, of which only the counts are used. A decision tree over the counts and densities of a block, its
two neighbours and its container, trained on the small labelled table below, decides what is main text; it knows no
names of elements or classes. Such names can only take a block away: what stands in an element that by its name is a
menu, a header, a footer, an advert, a form or reader comments is no text of the article, whatever its counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

TEXTS = "page_id long, url string, text string, n_chars long"

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)>?""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Elements whose content is never text of the page.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "svg", "select", "button", "object", "canvas"}
#: Of these, HTML reads all that follows as text; any other of ``_RAW`` without an end tag is one tag and nothing more.
_RAW_TEXT = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements that cut the list of blocks.
_CONTAINERS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "article", "main", "section", "div", "table", "body"}
_BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_BOILER_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "cookie", "cookies", "consent", "notice", "banner", "alert", "popup", "modal", "comment", "comments", "replies", "related",
    "recommended", "share", "sharing", "social", "subscribe", "newsletter", "signup", "login", "search", "form", "toolbar", "pagination", "contentinfo", "complementary",
}
#: Elements and names of articles; of their own parts, these names take nothing away.
_MAIN_TAGS, _MAIN_NAMES = {"article", "main"}, {"article", "main", "content", "post", "entry", "story"}
_PARTS = {"header", "banner", "notice", "alert", "form", "search"}

#: The labelled table: a page a line, containers between bars, and in each the words of its blocks (words/words in links).
#: Containers of main text have a plus sign; blocks of theirs that are none, an exclamation mark.
_LABELLED = """
1/1 1/1 2/2 1/1 | 9 | + 8 60 45 80 33 | 9
1/1 2/2 1/1 3/3 1/1 | + 7 52 18 90 | 11/3
2/2 1/1 1/1 | 14 | + 12 130 | 8
1/1 1/1 1/1 1/1 1/1 1/1 | 12 | + 12 15 | 10
1/1 1/1 1/1 | 8 | + 1 1 | 9
2/2 1/1 1/1 1/1 | 13 | + 2 3 | 12
1/1 1/1 1/1 1/1 | 7 | + 5 5 | 8
1/1 2/2 | 11 | + 12 13 40 | 9/1
3/3 2/2 2/2 4/4 | + 9 75 60/4 110 48 | 6/6 7/7 5/5 8/8 | 7
4 | 1/1 1/1 2/2 | + 10 35 6 48 5 66 | 20/18 15/14 18/15 | 12
2 9 | 3/3 1/1 2/2 1/1 | 25 | + 11 42 3 4 2 5 60 | 9
6/6 5/5 7/7 | + 44 58 39 | 5/5 9/9 4/4 | 15
+ 27 | 4/4 6/6 | 9
+ 60 35 80 | 8
+ 200
+ 5
+ 1 1
1/1 1/1 | + 90 | + 75 | + 120 | + 48 | 9 | 10/2
2/2 2/2 1/1 | 10 | + 30 | + 55 | + 41 | + 28 | 7 | 9
1/1 3/3 | + 9 | + 85 | + 62 | 8/8 6/6 5/5 | 6
1/1 1/1 2/2 1/1 | 12 | + 7 20/6 35/12 18 66 | 8/8 9/9 | 9
5/5 4/4 3/3 6/6 | + 14 3/3 80 45/20 2/2 70 | 3/3 4/4 2/2 | 14/7
1/1 1/1 1/1 1/1 | 15 | + 6 2 2 3 2 4 3 2 | 9
2/2 1/1 2/2 | 6 | + 12 22 31 | 5/5 5/5 | 10
3 | 2/2 2/2 | 18 | + 8 95 | 12/12 10/10 9/9 11/11 | 25 | 7
9/9 8/8 9/9 7/7 10/10 | 11/10 9/9 12/12 | 6
1/1 1/1 1/1 1/1 | 14 | 9
4/4 3/3 | 20/15 18/16 22/20 25/19 | 8
2/2 3/3 1/1 | 9 | + 12 19 | 13
1/1 2/2 1/1 | 10 | + 4 4 9 | 10
1/1 1/1 1/1 2/2 | 9 | + 12 300 12 280 1 150 | 11
2/2 2/2 2/2 | 8 | + 9 33 | 6
1/1 1/1 1/1 | 13 | + 3 3 | 7
1/1 1/1 2/2 1/1 | 9 | + 6 6 | 15
2/2 1/1 1/1 | 14 | + 3 3 | 17
1/1 2/2 1/1 | 24 | + 8 8 | 19
1/1 1/1 1/1 1/1 | 16 | + 7 7 | 18
3/3 1/1 1/1 | 12 | + 5 5 | 13
1/1 1/1 2/2 | 18 | + 11 11 | 25
1/1 1/1 | 10 | + 2 2 | 20
1/1 2/2 2/2 | 21 | + 9 9 | 22
1/1 1/1 1/1 2/2 | 14 | + 1 1 | 16
2/2 1/1 1/1 | 20 | + 1 1 | 12
+ !1/1 !1/1 40 55
+ !1/1 !2/2 !1/1 !3/3 12 60 35 80 !5/5 !6/6 !4/4
+ !2/2 !1/1 !1/1 90 44 !1/1 !2/2
+ !3/3 !2/2 9 70 22 65 !8/8 !9/9 !7/7 !6/6
+ !1/1 !1/1 30
+ 12
+ 16
+ 9
+ 21
1/1 1/1 | 5 | + 10 10 90 40 | 12
1/1 2/2 1/1 | 7 | + 12 70 | 15
1/1 1/1 2/2 1/1 | 6 | + 4 4 150 30 60 | 10
2/2 1/1 | 4 | + 12 45 30 | 9
2/2 1/1 1/1 | 5 | + 11 60 80 20 | 14/3
1/1 1/1 | 6 | + 12 12 33 25 | 11
1/1 1/1 1/1 | 8 | + 12 300 | 16
1/1 2/2 | 4 | + 9 18 22 | 10
1/1 2/2 1/1 | + 8 60 70 55 | 34/30 41/36 29/29 | 9
"""


@cache
def labelled_table() -> np.ndarray:
    """The features of each block of the labelled pages, and its label."""
    rows = []
    for line in _LABELLED.strip().splitlines():
        found, labels = [], []
        for i, container in enumerate(line.split("|")):
            for cell in container.split():
                if cell != "+":
                    words, _, linked = cell.lstrip("!").partition("/")
                    found.append(("", int(words), int(linked or 0), i, False))
                    labels.append("+" in container and cell[0] != "!")
        rows.append(np.column_stack([features(found), labels]))
    return np.vstack(rows)


def blocks(html: str) -> list[tuple[str, int, int, int, bool]]:
    """Text, words, words in links, number of its container, and whether a name takes it away, for each block in page order."""
    found: list[tuple[str, int, int, int, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # element, container, taken away, inside an article
    containers = 0
    text: list[str] = []
    links: list[str] = []
    in_link = False
    muted = ""  # the inline element with such a name that the text is in
    unended: set[str] = set()
    at, n = 0, len(html)

    def close_block() -> None:
        words = "".join(text).split()
        if words:
            linked = sum(len(x.split()) for x in links)
            found.append((" ".join(words), len(words), min(linked, len(words)), stack[-1][1], stack[-1][2]))
        text.clear()
        links.clear()

    while at < n:
        token = _TOKEN.search(html, at)
        piece = html[at : token.start() if token else n]
        if piece and not muted:
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                links.append(piece)
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue  # a comment or declaration
        tag, closing = token[2].lower(), bool(token[1])
        if tag in _RAW:
            if tag not in ("title", "textarea", "button", "select"):
                text.append(" ") if text else None
            if not closing and not token[3].endswith("/"):
                end = None if tag in unended else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                if end:
                    at = end.end()
                elif tag in _RAW_TEXT:
                    at = n
                else:
                    unended.add(tag)  # nor has a later one an end
            continue
        names = set()
        if not closing and token[3] and tag not in ("body", "html"):
            names = {w for m in _NAMED.finditer(token[3]) for w in re.split(r"[^a-z]+", m[1].lower())}
        named = bool((names - _PARTS if names & _MAIN_NAMES else names) & _BOILER_NAMES)
        if tag in _INLINE:
            if closing and tag == muted:
                muted = ""
            elif named and not muted and tag not in ("br", "img", "input", "wbr"):
                muted = tag
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                text.append(" ")
            continue
        close_block()
        in_link, muted = False, ""
        if stack[-1][0] in ("p", "li") and (tag == stack[-1][0] or tag in _CONTAINERS or closing):
            stack.pop()  # a named paragraph or item ends where the next one starts, or what holds it
        if tag not in _CONTAINERS and not (named and tag in ("p", "li")):
            if not closing and named:
                stack.append((tag, stack[-1][1], True, stack[-1][3]))
            elif closing and stack[-1][0] == tag:
                stack.pop()
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
        elif not token[3].endswith("/"):
            _, container, taken, main = stack[-1]
            if tag in _CONTAINERS:
                named = named or tag in _BOILER_TAGS and not (tag == "header" and main)
                if named or not main:  # the parts of an article are one container
                    containers += 1
                    container = containers
                main = main or tag in _MAIN_TAGS or bool(names & _MAIN_NAMES)
            stack.append((tag, container, taken or named, main))
    close_block()
    return found


def features(found: list[tuple[str, int, int, int, bool]]) -> np.ndarray:
    """Words and link density of each block, of the one before and the one after; words, link density, number of blocks and share of its container.

    The share is of the words of the page's largest container.
    """
    words, linked, container = (np.array([b[i] for b in found], dtype=float) for i in (1, 2, 3))
    own = np.column_stack([words, linked / np.maximum(words, 1)])
    around = np.vstack([np.zeros((1, 2)), own, np.zeros((1, 2))])
    _, place = np.unique(container, return_inverse=True)
    held, held_linked, count = np.bincount(place, words), np.bincount(place, linked), np.bincount(place)
    whole = np.column_stack([held, held_linked / np.maximum(held, 1), count, held / held.max(initial=1)])
    return np.column_stack([own, around[:-2], around[2:], whole[place]])


class DecisionTree:
    """A binary tree of threshold tests grown by Gini impurity until its leaves are pure."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.column = -1
        self.label = bool(labels.mean() >= 0.5)
        best = (self._impurity(labels) - 1e-12, 0, 0.0)
        for column in range(rows.shape[1]):
            values = np.unique(rows[:, column])
            for cut in (values[1:] + values[:-1]) / 2:
                low = rows[:, column] < cut
                best = min(best, (self._impurity(labels[low]) + self._impurity(labels[~low]), column, float(cut)))
        if best[0] < self._impurity(labels) - 1e-9:
            _, self.column, self.cut = best
            low = rows[:, self.column] < self.cut
            self.low, self.high = DecisionTree(rows[low], labels[low]), DecisionTree(rows[~low], labels[~low])

    @staticmethod
    def _impurity(labels: np.ndarray) -> float:
        share = labels.mean() if len(labels) else 0.0
        return 2 * share * (1 - share) * len(labels)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(rows), self.label)
        low = rows[:, self.column] < self.cut
        out = np.empty(len(rows), dtype=bool)
        out[low], out[~low] = self.low.predict(rows[low]), self.high.predict(rows[~low])
        return out


@cache
def default_tree() -> DecisionTree:
    table = labelled_table()
    return DecisionTree(table[:, :-1], table[:, -1])


def main_text(html: str | None) -> str:
    """The kept blocks of a page in their order, joined by newlines."""
    found = blocks(html or "")
    if not found:
        return ""
    kept = default_tree().predict(features(found))
    return "\n".join(block[0] for block, main in zip(found, kept, strict=True) if main and not block[4])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row; a null or empty page, or one without main text, gives an empty text.

    Repeated and null page_ids give a row each, an empty table none; other columns are left out. Pages are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html", 8 << 20):
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, TEXTS)
