"""Main text of web pages by tag-path ratios.

The text nodes of a page are filed under their root-to-leaf path of block elements, in a trie of paths. Each path has
a mean text length, a mean punctuation count and a whole text length, all outside links; they are smoothed over the
trie, by a weight that falls with every edge between two paths, and fused into one score: so a path gains by the text
near it, and short lines far from the bulk of the text lose. What a path's elements say of themselves weighs in: a
factor for standing in an article or main element, a small one for navigation, asides, forms and the like, and for
classes and ids that hint at such. A block is content if its own path or the region that it stands in reaches a share
of the page's best score, so headings and short lines go with the prose around them. Only elements that hold no text
to read (scripts, styles, form controls) and hidden ones are dropped outright.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without content of their own (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line of text (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Text-level blocks: what stands around them is their region (fixed values).
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption details summary address hgroup".split())
#: Elements without text to read; elements and roles that are seldom main text; words of class or id that hint at the
#: same (fixed values).
DROPPED = frozenset("head title button select option textarea input iframe object canvas audio video map noscript svg math template script style".split())
ASIDE = frozenset("nav aside footer form fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset(
    "nav navbar navigation menu menus header masthead topbar footer foot sidebar sidebars aside ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond discussion widget widgets toolbar pagination pager search tags skip paywall".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|title|textarea|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+|\"[^\"]*+\"|'[^']*+'")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
#: A path passes with this share of the page's best score.
THRESHOLD = 0.2
#: Factors of the score of a path inside an article or main element, inside an element or role that is seldom main text,
#: and inside an element whose class or id hints at that.
IN_ARTICLE, IN_ASIDE, IN_HINT = 2.0, 0.01, 0.02
#: Power of a path's whole text in its score, beside the square root of mean length and mean punctuation.
AMOUNT = 0.75
#: Weight of a path's neighbours in the smoothing, by each edge between them.
NEAR = 0.35


class Paths:
    """The trie of a page's paths: parents come before children. Each node has the region that it stands in, whether an
    article holds it, and the factor of its elements."""

    def __init__(self) -> None:
        self.parent, self.region, self.article, self.factor = [-1], [0], [False], [1.0]
        self._child: dict[tuple[int, str, float], int] = {}

    def child(self, of: int, tag: str, factor: float) -> int:
        key = (of, tag, factor)
        if key not in self._child:
            self._child[key] = node = len(self.parent)
            self.parent.append(of)
            self.region.append(self.region[of] if tag in TEXTUAL and factor == 1.0 else node)
            self.article.append(self.article[of] or tag in ("article", "main"))
            self.factor.append(min(self.factor[of], factor))
        return self._child[key]


def _factor(tag: str, attributes: str, in_article: bool) -> float:
    """The factor that an element's own tag, role, class and id give to the paths in it; 0 if it is dropped."""
    if tag in DROPPED:
        return 0.0
    own = IN_ASIDE if tag in ASIDE or (tag == "header" and not in_article) else 1.0
    if tag in ("html", "body") or ("=" not in attributes and "hidden" not in attributes.lower()):
        return own
    given: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes, NAME.match(attributes).end()):
        if m[1]:
            given.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of two of one name the first counts
    if "hidden" in given or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return 0.0
    if given.get("role", "").lower() in ROLES:
        own = IN_ASIDE
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", given.get("class", "") + " " + given.get("id", "")).lower())
    hits = {w for w in words if w in HINTS} - ({"header"} if in_article else set())
    if hits and not (tag in ("article", "main") and not any("comment" in w for w in hits)):
        own = min(own, IN_HINT)
    return own


class Reader:
    """Reads a page's tags in order. The stack holds the open elements, with ``None`` for inline ones that were closed
    among others; where each tag and where the blocks stand in it is kept, so no step searches the stack."""

    def __init__(self) -> None:
        self.paths, self.out = Paths(), []
        self.stack: list[tuple[str, int, bool] | None] = []  # tag, path, whether the element has a path of its own
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.text: list[str] = []
        self.links = self.in_link = self.skip = self.articles = 0  # skip: length of the stack at which dropped content began

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        if words and not self.skip:
            self.out.append((self.stack[-1][1] if self.stack else 0, words, self.links))
        self.text.clear()
        self.links = 0

    def say(self, raw: str) -> None:
        if raw and not self.skip:
            t = html.unescape(raw) if "&" in raw else raw
            self.text.append(t)
            self.links += len(t.strip()) if self.in_link else 0

    def push(self, tag: str, markup: str) -> None:
        path = self.stack[-1][1] if self.stack else 0
        factor = 1.0 if self.skip else _factor(tag, markup, self.articles > 0)
        if tag in INLINE and factor != 1.0:
            self.flush()
        named = tag not in INLINE or factor not in (0.0, 1.0)
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, self.paths.child(path, tag, factor) if named and factor else path, named))
        self.articles += tag in ("article", "main")
        if factor == 0.0:
            self.skip = len(self.stack)

    def cut(self, k: int) -> None:
        """Close all elements from the k-th on."""
        while len(self.stack) > k or self.stack and self.stack[-1] is None:
            frame = self.stack.pop()
            if frame is not None:
                self.at[frame[0]].pop()
                self.articles -= frame[0] in ("article", "main")
                if self.blocks and self.blocks[-1] == len(self.stack):
                    self.blocks.pop()
        self.skip = self.skip if len(self.stack) >= self.skip else 0

    def close(self, tag: str) -> None:
        where = self.at.get(tag)
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag not in INLINE:
            self.flush()
            self.in_link = 0
        if not where:
            return
        k = where[-1]
        if tag not in INLINE:
            self.cut(k)
        elif not self.blocks or self.blocks[-1] < k:  # an inline element ends only inside its own block
            if self.stack[k][2]:
                self.flush()
            if self.stack[k][2] or k == len(self.stack) - 1:
                self.cut(k)
            elif not self.skip:
                where.pop()
                self.stack[k] = None

    def open(self, tag: str, markup: str) -> None:
        if tag not in INLINE:
            self.flush()
            self.in_link = 0
            ends = CLOSED_BY.get(tag, ())
            while self.blocks and (self.stack[self.blocks[-1]][0] == "p" or self.stack[self.blocks[-1]][0] in ends):
                self.cut(self.blocks[-1])
        elif tag == "a":
            self.in_link += 1
        if not markup.endswith("/>"):
            self.push(tag, markup)

    def read(self, page: str) -> None:
        at = 0
        for m in TOKEN.finditer(page):
            self.say(page[at : m.start()])
            at = m.end()
            name = NAME.match(m[0])
            if m[1] or not name:
                continue
            tag = name[2].lower()
            if tag in ("br", "img"):
                self.text.append(" ")
            elif tag == "hr":
                self.flush()
            elif tag not in VOID:
                self.close(tag) if name[1] else self.open(tag, m[0])
        self.say(page[at:])
        self.flush()


def blocks(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The page's paths, and its text blocks in order: path, text, characters inside links."""
    reader = Reader()
    reader.read(page)
    return reader.paths, reader.out


def smoothed(parent: list[int], value: list[float]) -> list[float]:
    """Of each node of a trie the sum of all values, each times NEAR for every edge on the way: one pass up, one down."""
    up = list(value)
    for v in range(len(up) - 1, 0, -1):
        up[parent[v]] += NEAR * up[v]
    total = list(up)
    for v in range(1, len(up)):
        total[v] = up[v] + NEAR * (total[parent[v]] - NEAR * up[v])
    return total


def path_scores(paths: Paths, found: list[tuple[int, str, int]]) -> list[float]:
    """Per path the fused score of its smoothed ratios, times the factors of its elements."""
    length, marks, n = ([0.0] * len(paths.parent) for _ in range(3))
    for path, text, links in found:
        own = max(0, len(text) - links)
        length[path] += own
        marks[path] += len(PUNCTUATION.findall(text)) if own > links else 0
        n[path] += 1
    mean = lambda x: smoothed(paths.parent, [a / k if k else 0.0 for a, k in zip(x, n, strict=True)])
    weight = smoothed(paths.parent, [float(k > 0) for k in n])
    amount = smoothed(paths.parent, length)
    fused = (math.sqrt(a / w * (b / w + 0.1)) * c**AMOUNT if w else 0.0 for a, b, c, w in zip(mean(length), mean(marks), amount, weight, strict=True))
    return [x * f * (IN_ARTICLE if inside else 1.0) for x, f, inside in zip(fused, paths.factor, paths.article, strict=True)]


def main_text(page: str | None) -> str:
    """The main text of a page, blocks in order joined by a line feed; empty for null, empty and textless pages."""
    paths, found = blocks(page or "")
    if not found:
        return ""
    scores = path_scores(paths, found)
    least = THRESHOLD * max(scores[path] for path, _, _ in found)
    best: dict[int, float] = {}
    linked: dict[int, list[int]] = {}
    for path, text, links in found:
        r = paths.region[path]
        best[r] = max(best.get(r, 0.0), scores[path])
        n = linked.setdefault(r, [0, 0])
        n[0] += links
        n[1] += len(text)
    good = {r for r, s in best.items() if s >= least and 2 * linked[r][0] <= linked[r][1]}
    if not good:
        good = {max(best, key=best.get)}
    return "\n".join(text for path, text, _ in found if paths.region[path] in good)


def extract_main_text(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``out`` in place of the html; null html gives the empty text."""
    keep = [c for c in pages.columns if c not in (html_column, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(html_column)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, out])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` string"])
    return pages.mapInArrow(run, schema)


def op1_tag_path_ratios(pages: DataFrame) -> DataFrame:
    """Per page its main text and the text's length in code points.

    Null, empty and textless html give the empty text; a page of any length is read to its end; repeated pages stay; of
    equal scores all pass. A region whose text is mostly links goes, inside an article too.
    """
    from pyspark.sql import functions as F

    out = extract_main_text(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
