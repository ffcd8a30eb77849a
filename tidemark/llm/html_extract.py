"""Main text of web pages from shallow features of flat text blocks.

A page becomes a flat list of text blocks. Each has its word count and link density, those of the blocks before and
after it, and what its elements suggest: whether it is in an article, how much of the page is, how strongly an element
around it looks like something else, and how much of the page that element holds. None of these decides; a decision
tree, trained when first used on a small table of labelled page layouts, says which blocks are the article.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

# HTML's own element names, by what they do to the flow of text.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "object", "canvas", "title", "textarea", "select", "button", "video", "audio", "noembed", "noframes", "xmp"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
#: Of these, what stays open to the end of the page if it is never closed; the others end at the next block.
TO_THE_END = {"script", "style", "template", "textarea", "title", "noscript", "xmp"}
OUTSIDE = {"nav", "aside", "footer", "menu", "dialog", "head"}
FORMS = {"form", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in a class or id that name what is not the article.
HINTS = set("ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus replies reply respond sidebar related recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs footer masthead widget pagination pager tags toolbar copyright legal disclaimer".split())
#: Words in a class or id that say nothing of what it holds.
NEUTRAL = set("container box block wrapper wrap inner outer area section slot unit item list bar top bottom left right main page site body content text col row js".split())
#: Words in a class or id by which an element has something beside it.
BESIDE = {"has", "with", "without", "no", "not"}

ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
TAG = re.compile(rf"<(/?)([A-Za-z][^\s/>]*)({ATTRIBUTES})>")
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    element: int
    heading: int
    article: int = 0
    article_share: float = 0.0
    aside: float = 0.0  # of its elements, the strongest sign of not being the article: 2 by its kind, up to 1 by its class
    aside_share: float = 0.0  # share of the page's words in the outermost element of that strength


BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS)) + r")(?=[\s/>])", re.I)


def pieces(html: str):
    """('text', s), ('open', name, attributes), ('close', name) in page order. Linear in the page's length."""
    at, n, quoted = 0, len(html), True
    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            yield "text", html[at:], ""
            return
        if cut > at:
            yield "text", html[at:cut], ""
        if html.startswith("<!--", cut):
            end = html.find("-->", cut + 4)
            at = n if end < 0 else end + 3
            continue
        follow = html[cut + 1 : cut + 2]
        if follow in "!?" and follow:
            end = html.find(">", cut)
            at = n if end < 0 else end + 1
            continue
        if not (follow.isalpha() or follow == "/" and html[cut + 2 : cut + 3].isalpha()):
            yield "text", "<", ""
            at = cut + 1
            continue
        tag = TAG.match(html, cut) if quoted else None
        if tag:
            closing, name, attributes, at = tag[1], tag[2].lower(), tag[3], tag.end()
        else:  # a quote that never closes: from here on, tags end at the next >
            quoted, end = False, html.find(">", cut)
            if end < 0:
                return
            inner = html[cut + 1 : end].lstrip("/")
            closing, name, attributes, at = html[cut + 1] == "/" and "/", (inner.split(None, 1) or [""])[0].rstrip("/").lower(), inner[len(inner.split(None, 1)[0]) :], end + 1
        if closing:
            yield "close", name, ""
        elif name in RAW:
            if not attributes.rstrip().endswith("/"):
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                end = html.find(">", found.end()) if found else -1
                if name not in TO_THE_END and (not found or end < 0):
                    block = BLOCK_TAG.search(html, at)
                    at = block.start() if block else n
                else:
                    at = n if not found or end < 0 else end + 1
            if name not in ("script", "style", "template"):
                yield "text", " ", ""
        else:
            yield "open", name, attributes


def hint_strength(value: str) -> float:
    """How far the words of a class name or id are words for what is not the article."""
    words = [w.lower() for w in WORDS.findall(value)]
    if BESIDE & set(words):
        return 0.0
    telling = [w for w in words if w in HINTS or w not in NEUTRAL]
    return sum(w in HINTS for w in telling) / len(telling) if telling else 0.0


def signs(name: str, attributes: str) -> float:
    """How strongly an element looks like something that is not the article; a page's header: -1."""
    strength = 2.0 if name in OUTSIDE else 1.0 if name in FORMS else -1.0 if name == "header" else 0.0
    for key, value in NAMED.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
            return 2.0
        if key == "role":
            role = value.lower()
            strength = 2.0 if role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert") else max(strength, 1.0) if role == "form" else strength
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            hint = max((hint_strength(x) for x in value.split()), default=0.0)
            strength = hint if hint > abs(strength) else strength
    return strength


def tell_elements(elements: list[tuple[int, float, bool]], blocks: list[Block]) -> None:
    """Fills in what the elements around each block suggest. elements: parent (further up), sign, whether an article."""
    words = [0] * len(elements)
    for b in blocks:
        words[b.element] += b.words
    for e in range(len(elements) - 1, 0, -1):
        words[elements[e][0]] += words[e]
    total = max(1, words[0])
    told: list[tuple[bool, float, float]] = [(False, 0.0, 0.0)]
    inside = 0
    for e in range(1, len(elements)):
        parent, sign, article = elements[e]
        within, strength, share = told[parent]
        if sign < 0:
            sign = 0.0 if within else 2.0
        if sign > strength:
            strength, share = sign, words[e] / total
        if article and not within:
            inside += words[e]
        told.append((within or article, strength, share))
    for b in blocks:
        within, b.aside, b.aside_share = told[b.element]
        b.article, b.article_share = int(within), inside / total


class Open:
    """The elements that are open, innermost last, how many there are of each name, and all that ever were."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.count: dict[str, int] = {}
        self.elements: list[tuple[int, float, bool]] = [(0, 0.0, False)]

    @property
    def element(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def push(self, name: str, sign: float = 0.0) -> None:
        self.elements.append((self.element, sign, name in ("article", "main")))
        self.stack.append((name, len(self.elements) - 1))
        self.count[name] = self.count.get(name, 0) + 1

    def has(self, name: str) -> bool:
        return self.count.get(name, 0) > 0

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.count[name] -= 1
        return name

    def close(self, name: str) -> None:
        """Closes the innermost element of the name, and all inside it."""
        while self.has(name) and self.pop() != name:
            pass


def blocks_of(html: str) -> list[Block]:
    out: list[Block] = []
    opened, links, heading = Open(), 0, 0
    held: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        if text:
            n = text.count(" ") + 1
            out.append(Block(text, n, min(n, len(unescape(" ".join(linked)).split())), opened.element, heading))
        held.clear()
        linked.clear()

    for kind, name, attributes in pieces(html):
        if kind == "text":
            held.append(name)
            if links:
                linked.append(name)
        elif kind == "open":
            if name == "br":
                held.append(" ")
            elif name in VOID and name != "hr":
                continue
            elif name in BLOCKS:
                flush()
                if opened.stack and opened.stack[-1][0] == "p":
                    opened.pop()
                if name != "hr":
                    opened.push(name, signs(name, attributes))
                heading, links = int(name in HEADINGS), 0
            elif name == "a":
                links = 1
            elif attributes and (sign := signs(name, attributes)) > 0:  # an inline element that may not be the article
                flush()
                opened.push(name, sign)
            elif opened.has(name):
                opened.push(name)
        elif name == "a":
            links = 0
        elif name in BLOCKS or opened.has(name):
            flush()
            heading = 0
            opened.close(name)
    flush()
    tell_elements(opened.elements, out)
    return out


FEATURES = ("words", "links", "heading", "article", "article_share", "aside", "aside_share", "words_before", "links_before", "words_after", "links_after")


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES per block of a page, in order."""
    if not blocks:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked for b in blocks]) / words
    told = np.array([(b.heading, b.article, b.article_share, b.aside, b.aside_share) for b in blocks], float)
    before, after = (lambda v: np.append(0.0, v[:-1])), (lambda v: np.append(v[1:], 0.0))
    return np.column_stack((words, links, told, before(words), before(links), after(words), after(links)))


#: Labelled page layouts, hand-made after common kinds of pages: =n stands for n words of the article, ~n for n others.
LABELLED = (
    # a news page with all the elements that HTML has for it
    "<header><a>~2</a></header><nav><ul><li><a>~1</a><li><a>~1</a><li><a>~2</a></ul></nav><article><h1>=9</h1><p>=40<p>=62 <a>=3</a> =10<p>=4<aside><h3>~2</h3><p>~25</aside><p>=33</article><footer><p>~12</footer>",
    "<nav><ul><li><a>~1</a><li><a>~1</a><li><a>~1</a></ul></nav><div class=ad>~8</div><article><h1>=7</h1><p>=30<p>=80<p>=1<p>=12</article><footer>~9</footer>",
    "<nav><ul><li><a>~1</a><li><a>~1</a></ul></nav><div class=ad>~14</div><article><h1>=12</h1><p>=6</article><footer>~15</footer>",
    "<nav><a>~1</a> <a>~1</a></nav><article><p>=3</article><footer>~20</footer>",
    "<header><p>~4</header><main><h1>=6</h1><p>=25<p>=3<ul><li>=5<li>=9<li>=4 <a>=2</a></ul><p>=50</main><footer>~6 <a>~2</a></footer>",
    # little article and much else
    "<nav><ul><li><a>~9</a><li><a>~14</a><li><a>~22</a></ul></nav><article><p>=3</article>", "<nav>~40 <a>~3</a></nav><p>=5", "<aside><p>~90</aside><div><p>=6</div>", "<nav><a>~30</a><p>~4</nav><footer>~60</footer>",
    "<header><p>~30<p>~25</header><article><h1>=2</h1><p>=1</article><footer><p>~50<p>~44</footer>", "<div hidden><p>~70<p>~66</div><article>=4</article>", "<article><h1>=3</h1><p>=2</article><aside><a>~5</a><p>~80</aside>",
    # headers inside articles, notices, newsletters and adverts among paragraphs
    "<div class=cookie-notice><p>~22 <a>~2</a></div><article><header><h1>=8</h1><p>=4</header><p>=45<div class=ad-slot>~11</div><p>=38<div class=newsletter-signup><p>~18</div><p>=52</article><div class=sidebar><p>~30<p>~16</div>",
    "<article><h1>=5</h1><p>=35<div class=advert><p>~14</div><p>=21</article><section class=related><ul><li><a>~6</a><li><a>~7</a></ul></section><div hidden><p>~16</div>",
    "<div class=banner>~9</div><main><p>=44<p>=28<div class=share>~3 <a>~1</a></div></main><div class=popup><p>~19</div>",
    # classes that only sound like something else
    "<article><h1>=4</h1><section class=social-history><h2>=2</h2><p>=40<p>=31</section><section class=tag-systems><p>=25</section></article><footer>~7</footer>",
    "<nav><a>~2</a></nav><div class=legal-theory><h1>=5</h1><p>=60<p>=18</div><footer>~8</footer>",
    # wrappers that hold the page
    "<form><nav><a>~1</a></nav><div><h1>=6</h1><p>=40<p>=24<p>=33</div><footer>~3</footer></form>",
    "<form><article><h1>=6</h1><p>=40<p>=24</article></form><footer>~2</footer>",
    "<nav><ul><li><a>~1</a><li><a>~1</a></ul></nav><div class=sidebar><article><h1>=5</h1><p>=70<p>=30</article></div><footer>~2</footer>",
    "<div class=menu><div><h1>=4</h1><p>=14<p>=15<p>=3</div></div><footer>~1</footer>",
    "<main><form><h1>=4</h1><p>=14<p>=15<p>=3</form></main><footer>~1</footer>",
    "<nav><ul><li><a>~1</a><li><a>~1</a><li><a>~2</a></ul></nav><form><article><h1>=4</h1><p>=13<p>=14<p>=2</article><div class=related><ul><li><a>~1</a><li><a>~2</a></ul></div></form><footer><p>~2</footer>",
    "<nav><ul><li><a>~1</a><li><a>~1</a><li><a>~3</a></ul></nav><div class=menu><div><h1>=4</h1><p>=13<p>=14<p>=2</div></div><footer><p>~3</footer>",
    # reader comments, few and many
    "<article><h1>=6</h1><p>=55<p>=29</article><div class=comments><h3>~2</h3><p>~40<p>~65<p>~18</div>",
    "<article><h1>=5</h1><p>=14<p>=16<p>=2<div class=comments><p>~14<p>~20</div></article>",
    "<article><h1>=5</h1><p>=14<p>=16<p>=2</article><div class=comments><article><p>~14</article><article><p>~14</article><article><p>~14</article><article><p>~30</article></div>",
    "<article><h1>=5</h1><p>=20<p>=16<p>=2<div class=comments><article><p>~40</article><article><p>~44</article><article><p>~21</article></div></article>",
    "<article><h1>=5</h1><p>=12<p>=14<p>=2</article><div class=comments><article><p>~44</article><article><p>~44</article><article><p>~38</article></div>",
    "<main><h1>=3</h1><p>=14<p>=3<form><p>~14<label>~1</label></form></main>",
    "<main><h1>=4</h1><p>=60<p>=44<form><p>~14<label>~1</label></form></main>",
    # teasers in article elements beside a text that has none
    "<div class=content><h1>=6</h1><p>=50<p>=41<p>=28</div><article><p>~9 <a>~4</a></article>",
    "<div><h1>=5</h1><p>=70<p>=35<p>=40</div><article><h3><a>~5</a></h3><p>~12</article><article><h3><a>~6</a></h3><p>~11</article>",
    "<article><p>~8</article><div class=content><p>=45<p>=33<p>=52</div><footer>~4</footer>",
    # no telling elements at all
    "<div><a>~1</a> <a>~1</a> <a>~2</a></div><div><h1>=7</h1><p>=33<p>=18<p>=28 <a>=1</a><p>=14<p>=52</div><div><a>~4</a></div><div>~3 <a>~3</a></div>",
    "<div><ul><li><a>~1</a><li><a>~1</a><li><a>~2</a></ul></div><div><h1>=4</h1><p>=14<p>=13<p>=14</div><div><a>~2</a></div><div><ul><li><a>~1</a><li><a>~1</a><li><a>~2</a></ul></div>",
    "<div><a>~6</a></div><div><a>~4</a></div><div>~3</div><h2>=9</h2><div>=70 <a>=3</a></div><div>=55</div><div>=40 <a>=5</a></div><div>=95</div><div>~3</div><div><a>~5</a></div><div><a>~6</a></div><div>~6 <a>~2</a></div>",
    "<table><tr><td><a>~2</a><td><a>~2</a><td><a>~2</a></table><h1>=7</h1><p>=33<p>=18<p>=28 <a>=1</a><p>=14<p>=52<p><a>~4</a><p>~6 <a>~3</a>",
    "<p><a>~11</a><p>~2 <a>~12</a><p><a>~12</a><p><a>~10</a><h2>~5</h2><p><a>~13</a><p>~1 <a>~11</a>",
    "<p>=160", "<p>=26<p>=21<p>=17", "<p>=6<p>=1", "<p>=1", "<h1>=2</h1><p>=3<p>=1", "<article><p>=4</article>", "<article>=1</article>",
    "<article><h1>=1</h1><p>=1</article>", "<nav><a>~1</a></nav><article><p>=1</article>", "<article><p>=3 <a>=2</a></article>", "<article><h2>=1</h2>=1 <a>=2</a></article>",
    "<h1>=4</h1><p>=35<p>~3<p><a>~3</a>",
    "<ul><li><a>~1</a><li><a>~3</a></ul><h1>=8</h1><p>=14<p>=23 <a>=3</a><p>=13<p><a>~2</a><p><a>~2</a>",
    "<p><a>~3</a><p>=17<p>=48<p>=9<p><a>~3</a>",
    "<article><p>=210 <a>=4</a><p>=16<p>~1 <a>~5</a></article><footer>~20</footer>",
    "<nav><a>~7</a></nav><div class=toolbar>~9</div><h1>=11</h1><p>=12<p>=8<p>=24 <a>=6</a><p>=10<footer>~14</footer>",
)
COUNT = re.compile(r"([=~])(\d+)")
#: Where elements tell, and not the share that one holds, lengths do not matter: such layouts count with others too.
LENGTHS = ((1, 1), (0.25, 1), (4, 1), (1, 4), (1, 0.25))


def labelled_blocks(layout: str, article: float = 1, rest: float = 1) -> list[tuple[Block, int]]:
    """The blocks of a labelled layout, its lengths times so much, and whether each is of the article."""

    def said(m: re.Match) -> str:
        word, times = ("yes", article) if m[1] == "=" else ("no", rest)
        return " ".join([word] * max(1, round(int(m[2]) * times)))

    return [(b, int(b.text.startswith("yes"))) for b in blocks_of(COUNT.sub(said, layout))]


@dataclass(frozen=True)
class Tree:
    """A binary decision tree as arrays; a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def keep(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            low = x[np.arange(len(x)), self.feature[node]] <= self.threshold[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.value[node] > 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 2) -> Tree:
    """Least Gini impurity, splits midway between values."""
    nodes: list[list] = []

    def build(rows: np.ndarray, room: int) -> int:
        me, share = len(nodes), y[rows].mean()
        nodes.append([0, 0.0, me, me, share])
        best = (2 * share * (1 - share) * len(rows) - 1e-9, None)
        if room and 0 < share < 1:
            for k in range(x.shape[1]):
                values = np.unique(x[rows, k])
                for t in (values[:-1] + values[1:]) / 2:
                    low = x[rows, k] <= t
                    if min(low.sum(), (~low).sum()) < least:
                        continue
                    cost = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (y[rows][low], y[rows][~low]))
                    if cost < best[0]:
                        best = (cost, (k, t, low))
        if best[1]:
            k, t, low = best[1]
            nodes[me][:4] = [k, t, build(rows[low], room - 1), build(rows[~low], room - 1)]
        return me

    build(np.arange(len(y)), depth)
    columns = [np.array(c) for c in zip(*nodes, strict=True)]
    return Tree(*columns, depth)


@lru_cache(maxsize=1)
def trained() -> Tree:
    told, shares = re.compile(r"<(article|main|nav|aside|header|footer)|hidden"), re.compile("comments|<form|sidebar|menu")
    pages = [labelled_blocks(page, *times) for page in LABELLED for times in (LENGTHS if told.search(page) and not shares.search(page) else LENGTHS[:1])]
    x = np.concatenate([features([b for b, _ in page]) for page in pages])
    return grow(x, np.array([label for page in pages for _, label in page], float))


def main_text(html: str, tree: Tree | None = None) -> str:
    """The blocks that the tree keeps, in page order, joined by \\n."""
    blocks = blocks_of(html)
    keep = (tree or trained()).keep(features(blocks)) if blocks else ()
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points of text).

    Whole pages are read; null or empty html gives an empty text. Character references are decoded, white space in a
    block becomes one space, a line break is white space. Null keys and repeated rows pass through as they are; an
    empty table gives no rows; extra columns are not read. One narrow pass, nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            text = [main_text(h) for h in strings(batch.column("html"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"], pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
