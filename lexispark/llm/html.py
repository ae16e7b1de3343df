"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into text blocks with their place in the element tree. A logistic
classifier, trained from a small labelled table of blocks, gives each block a cost for either label;
these costs are the capacities of its edges to the terminals. Neighbouring blocks, and blocks
of one parent, are tied by edges whose capacities fall with their distance in the tree (the steps between their
elements) or on the page. The minimum cut (Dinic's maximum flow) separates content from boilerplate at the least cost in all.

Attributes are read by name and value. A class, id or role speaks for a label only if all parts of one of its
words are known (`cookie-notice`, not `side-effects`). A form that holds an article, a heading of the first two
ranks or much prose is the page's own; others are controls.

Nulls: a null or empty page has an empty text; a null url stays null. Broken markup is read as far as it
goes; nothing is cut off. Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_rows
from .toxicity import logistic

#: Markup: comments and declarations, or tags with their attributes. Quoted values may hold '>'.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.DOTALL)
#: Name and value of an attribute; values are passed over as a whole, so nothing inside one counts as a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "noembed", "noframes", "math", "object", "select", "canvas"}
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end blocks.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSED_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "button"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Words in class, id and role that speak for one label or the other, and words that say no more than where or which.
BOILER = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsors sponsored promo promos promotion cookie cookies notice notices consent gdpr alert menu menus nav navbar "
    "navigation sidebar sidenav aside footer foot header masthead topbar topnav breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe subscription widget "
    "widgets popup modal overlay login signup signin search toolbar pagination pager tags copyright disclaimer outbrain taboola contentinfo complementary adsbygoogle".split()
)
COMMENT = set("comment comments commentlist commentarea disqus reply replies respond discussion discussions thread threads".split())
CONTENT = set("article articles content post posts entry entries story stories main maincontent articlebody text body prose blogpost bodytext".split())
NEUTRAL = set(
    "site page global top bottom left right center middle primary secondary box boxes container wrap wrapper inner outer block list listing item items section area bar panel slot unit holder row col column "
    "columns grid group module region zone links link buttons button icons icon media image logo title heading head meta info author date category label form field input text wide narrow large small full first "
    "last even odd new old more all user reader readers blog news web js wp id the of and for google fixed sticky mobile desktop print".split()
)
#: Words with which a header belongs to an article; prefixes after which a word says what is beside the element, not in it.
TITLED = {"article", "post", "entry", "story", "articles", "posts", "entries", "stories"}
BESIDE = {"has", "with", "no", "without", "is", "not", "hide", "show", "after", "before"}
CONTROL = {"button", "fieldset", "label", "option", "dialog"}
SIDE = {"nav", "footer", "aside", "menu", "search"}
#: Words of prose, outside controls, from which a form counts as the page's own.
PAGE_FORM_WORDS = 60

#: Weight of ties between blocks: of neighbours in page order, and of blocks with one parent.
NEXT_TIE, PARENT_TIE = 0.35, 0.35
SCALE = 1000


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    marks: frozenset  # of the element and those around it
    jump: int  # an ancestor further up, so that any is reached in few steps
    form: int = -1  # the form around it
    inline: dict | None = None  # in a block element: how often each inline tag is open directly in it


@dataclass
class Block:
    tag: str
    parent: int
    at: int  # its element
    marks: frozenset
    form: int = -1
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


@dataclass
class Page:
    blocks: list[Block]
    elements: list[Element]

    def distance(self, a: int, b: int) -> int:
        """Steps between two elements along the tree, through their nearest common ancestor."""
        e = self.elements
        steps = e[a].depth + e[b].depth
        if e[a].depth < e[b].depth:
            a, b = b, a
        while e[a].depth > e[b].depth:
            a = e[a].jump if e[e[a].jump].depth >= e[b].depth else e[a].parent
        while a != b:
            a, b = (e[a].jump, e[b].jump) if e[a].jump != e[b].jump else (e[a].parent, e[b].parent)
        return steps - 2 * e[a].depth


#: Parts of a class word: runs of letters of one case after a capital, and digits.
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
KNOWN = BOILER | COMMENT | CONTENT | NEUTRAL


@lru_cache(maxsize=4096)
def marks_of(tag: str, attributes: str) -> frozenset:
    """What an element's tag, class, id and role say about the text in it."""
    out = set()
    if tag in SIDE:
        out.add("side")
    elif tag in CONTROL:
        out.add("form")
    elif tag == "header":
        out.add("header")
    elif tag in ("article", "main"):
        out.add("content")
    if attributes and tag not in ("html", "body"):  # their classes describe the whole page
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            low = value.lower()
            if name == "hidden" or (name == "aria-hidden" and low.strip() == "true") or (name == "style" and re.search(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)", low)):
                out.add("hidden")
            elif name in ("class", "id", "role"):
                for word in value.split():
                    own = [p.lower() for p in PARTS.findall(word)]
                    own = [p for p in own if not p.isdigit()]
                    if not own or own[0] in BESIDE or not KNOWN.issuperset(own):
                        continue
                    parts = set(own)
                    if parts & TITLED:  # the heading of the article, not of the site
                        parts -= {"header", "head"}
                    if parts & BOILER:
                        out.add("boiler")
                    if parts & COMMENT:
                        out.add("comment")
                    if parts & CONTENT and not parts & BOILER:
                        out.add("content")
    return frozenset(out)


def blocks_of(page: str) -> Page:
    """The text blocks of a page in order, and its elements."""
    root = Element("html", -1, 0, frozenset(), 0, inline={})
    elements, stack, holders, out = [root], [0], [0], []  # holders: the open block elements, as places in the stack
    block: Block | None = None
    links, at, n = 0, 0, len(page)
    open_blocks: dict[str, int] = {}

    def add(piece: str) -> None:
        nonlocal block
        if block is None:
            if piece.isspace():
                return
            k = stack[-1]
            e = elements[k]
            block = Block(e.tag, e.parent if e.tag in ("p", "li", "b") or e.tag in HEADINGS else k, k, e.marks, e.form)
        piece = html.unescape(piece) if "&" in piece else piece
        block.parts.append(piece)
        if links:
            block.linked += len(piece)

    def flush() -> None:
        nonlocal block
        if block is not None and block.text:
            out.append(block)
        block = None

    def close(place: int) -> None:
        """Closes the element at this place of the stack and all within it."""
        while len(stack) > place:
            e = elements[stack.pop()]
            if e.inline is not None:
                holders.pop()
                open_blocks[e.tag] -= 1
            else:
                elements[stack[holders[-1]]].inline[e.tag] -= 1

    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # a closing tag
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                flush()
                if open_blocks.get(tag):
                    close(next(h for h in reversed(holders) if elements[stack[h]].tag == tag))
            elif elements[stack[holders[-1]]].inline.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag))
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        if tag == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            links = 0
            closed = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSED_P else set())
            while holders[-1] and elements[stack[holders[-1]]].tag in closed:
                close(holders[-1])
        if tag == "a":
            links += 1
        if tag not in VOID and not m[3].endswith("/>"):
            k = stack[-1]
            parent = elements[k]
            own = marks_of(tag, m[3].rstrip(">").strip())
            far = elements[parent.jump]
            jump = far.jump if parent.depth - far.depth == far.depth - elements[far.jump].depth else k
            e = Element(tag, k, parent.depth + 1, parent.marks | own if own - parent.marks else parent.marks, jump, len(elements) if tag == "form" else parent.form)
            elements.append(e)
            stack.append(len(elements) - 1)
            if tag in BLOCK:
                e.inline = {}
                holders.append(len(stack) - 1)
                open_blocks[tag] = open_blocks.get(tag, 0) + 1
            else:
                inline = elements[stack[holders[-1]]].inline
                inline[tag] = inline.get(tag, 0) + 1
    flush()
    mark_forms(out)
    return Page(out, elements)


def mark_forms(blocks: list[Block]) -> None:
    """Marks the blocks of forms, but for those of a form that is the page's own."""
    words: dict[int, int] = {}
    for b in blocks:
        if b.form >= 0 and not b.marks & {"form", "side", "boiler", "comment", "hidden"}:
            of_article = "content" in b.marks or b.tag in ("h1", "h2")
            words[b.form] = words.get(b.form, 0) + (PAGE_FORM_WORDS if of_article else b.text.count(" ") + 1 if b.tag != "li" else 0)
    for b in blocks:
        if b.form >= 0 and words.get(b.form, 0) < PAGE_FORM_WORDS:
            b.marks |= {"form"}


def features(tag: str, marks: frozenset, text: str, linked: int) -> list[float]:
    words = text.count(" ") + 1
    return [
        1.0,
        "side" in marks,
        "header" in marks and "content" not in marks,
        "boiler" in marks,
        "comment" in marks,
        "content" in marks,
        "form" in marks,
        "hidden" in marks,
        min(1.0, linked / max(1, len(text))),
        min(1.0, math.log1p(words) / 5),
        text[-1:] in ".!?\"'”»:…",
        tag in HEADINGS,
        tag in ("p", "blockquote", "pre"),
    ]


#: The labelled table: (label, tag, marks, words, linked share, ends a sentence), each standing for one block.
LABELLED = [
    *[(1, "p", m, w, 0.0, 1) for m in ("content", "") for w in (4, 12, 40, 90, 200)],
    *[(1, "p", "content", w, 0.0, 0) for w in (1, 6, 30)],
    *[(1, "p", "content", w, 0.2, 1) for w in (15, 60)],
    *[(1, t, "content", w, 0.0, 0) for t in ("h1", "h2", "h3") for w in (1, 5, 12)],
    *[(1, "h1", "header content", 8, 0.0, 0), (1, "h1", "", 8, 0.0, 0), (1, "li", "content", 12, 0.0, 1), (1, "li", "content", 3, 0.0, 0)],
    *[(1, "blockquote", "content", 25, 0.0, 1), (1, "pre", "content", 30, 0.0, 0), (1, "td", "content", 4, 0.0, 0), (1, "div", "content", 50, 0.0, 1), (1, "div", "", 120, 0.0, 1), (1, "figcaption", "content", 9, 0.0, 1)],
    *[(0, "li", m, w, 1.0, 0) for m in ("side", "boiler", "side boiler", "") for w in (1, 2, 4)],
    *[(0, t, m, w, 0.1, e) for t in ("p", "div") for m in ("side", "boiler", "side content", "boiler content") for w in (3, 12, 40, 100) for e in (0, 1)],
    *[(0, t, m, w, 0.0, e) for t in ("p", "div", "li") for m in ("comment", "comment content") for w in (4, 20, 80) for e in (0, 1)],
    *[(0, t, "form", w, 0.0, 0) for t in ("div", "button", "form") for w in (1, 4, 10)],
    *[(0, "p", "form content", 6, 0.0, 1), (0, "div", "header", 4, 0.3, 0), (0, "h1", "header", 4, 0.0, 0), (0, "p", "header", 12, 0.0, 1), (0, "p", "header boiler", 12, 0.0, 1)],
    *[(0, t, m, 5, 0.0, 0) for t in ("h2", "h3") for m in ("side", "boiler", "comment", "form", "side content", "boiler content", "comment content")],
    *[(0, "p", "hidden", 30, 0.0, 1), (0, "p", "hidden content", 30, 0.0, 1), (0, "div", "", 2, 1.0, 0), (0, "div", "", 3, 0.0, 0), (0, "div", "", 5, 0.8, 0), (0, "p", "", 4, 1.0, 0), (0, "p", "content", 4, 1.0, 0)],
]


@lru_cache(maxsize=1)
def classifier() -> np.ndarray:
    """Coefficients of the logistic model of label 1 (content), from the labelled table."""
    x = [features(tag, frozenset(m.split()), " ".join(["word"] * w) + "." * e, round(linked * (5 * w - 1))) for _, tag, m, w, linked, e in LABELLED]
    y = np.array([r[0] for r in LABELLED], dtype=np.float64)
    return logistic(np.array(x, dtype=np.float64), y, np.ones(len(y)), ridge=0.05)


def minimum_cut(gain: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side. gain: the capacity from the source less that to the sink; ties: (node, node, capacity both ways).

    Of equal cuts the one with the smallest source side is taken.
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            edge(source, i, g, 0)
        elif g < 0:
            edge(i, sink, -g, 0)
    for a, b, c in ties:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        place = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                c = min(room[e] for e in path)
                for e in path:
                    room[e] -= c
                    room[e ^ 1] += c
                k = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while place[a] < len(out[a]):
                e = out[a][place[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                place[a] += 1
            if place[a] < len(out[a]):
                path.append(out[a][place[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
                place[a] += 1
            else:
                break


def label_blocks(page: Page, beta: np.ndarray) -> list[bool]:
    """Whether each block is content."""
    blocks = page.blocks
    if not blocks:
        return []
    x = np.array([features(b.tag, b.marks, b.text, b.linked) for b in blocks], dtype=np.float64)
    # the costs are -log p of either label; their difference is the log-odds
    gain = [int(g) for g in np.rint(SCALE * np.clip(x @ beta, -20, 20))]
    ties, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            ties.append((i - 1, i, int(SCALE * NEXT_TIE / max(1, page.distance(blocks[i - 1].at, b.at) - 1))))
        if b.parent in last and last[b.parent] < i - 1:
            ties.append((last[b.parent], i, int(SCALE * PARENT_TIE / (i - last[b.parent]))))
        last[b.parent] = i
    return minimum_cut(gain, ties)


def main_text(page: str | None, beta: np.ndarray | None = None) -> str:
    read = blocks_of(page or "")
    keep = label_blocks(read, classifier() if beta is None else beta)
    return "\n\n".join(b.text for b, k in zip(read.blocks, keep) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    kinds = dict(pages.dtypes)

    def make():
        beta = classifier()

        def step(batch):
            texts = [main_text(t, beta) for t in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return arrow_rows(pages.select("page_id", "url", "html"), make, f"page_id {kinds['page_id']}, url string, text string, n_chars long", batch_rows=500)
