"""A small DOM of a page: element nodes with their text blocks, and measures of each node."""

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from math import log1p

import numpy as np

#: Fixed values of HTML: elements without content, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template iframe object svg math canvas select textarea button".split())
#: Elements that end when a sibling of their kind begins, and the elements that bound the search for it.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Words of class, id and role attributes that name page parts.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form gdpr header legal login masthead menu modal nav "
    "navbar navigation newsletter notice pager pagination popup promo related reply replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe tags toolbar widget widgets".split())
MAIN_WORDS = frozenset("article articlebody body content entry main post postbody story text".split())
TAGS = ["html", "head", "body", "title", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "p", "h", "list", "table", "quote", "hidden", "other"]
_TAG = {t: k for k, t in enumerate(TAGS)} | {f"h{k}": TAGS.index("h") for k in range(1, 7)}
_TAG |= {t: TAGS.index("list") for t in ("ul", "ol", "li", "dl", "dt", "dd", "menu")} | {t: TAGS.index("table") for t in ("table", "tr", "td", "th", "tbody", "thead", "tfoot")}
_TAG |= {t: TAGS.index("quote") for t in ("blockquote", "pre", "figure", "figcaption")} | {t: TAGS.index("hidden") for t in HIDDEN}
_WORD = re.compile("[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "children", "chars", "link_chars", "texts", "marks", "main")

    def __init__(self, tag: str, parent: int, depth: int, words: frozenset, main: bool):
        self.tag, self.parent, self.depth, self.words, self.main = tag, parent, depth, words, main
        self.children: list[int] = []
        self.chars = self.link_chars = self.texts = self.marks = 0


class Page(HTMLParser):
    """Nodes in page order (parents first) and text blocks (node, text). Inline elements are no nodes of their own."""

    def __init__(self, html: str, label: str | None = None):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0, frozenset(), False)]
        self.open: list[tuple[str, int]] = []  # open elements and their node
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements by tag, innermost last
        self.nested: list[int] = []  # places of open elements that are nodes
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.links = 0
        self.label = label
        self.here = 0
        self.feed(html)
        self.close()
        self._end_block()

    def _end_block(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if text:
                self.blocks.append((self.here, text))
                node = self.nodes[self.here]
                node.texts += 1
                node.chars += len(text)
                node.marks += sum(map(text.count, ".,;:!?"))

    def _push(self, tag: str, attrs: list) -> None:
        words = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORD.findall(v.lower()))
        main = self.label is not None and any(k == self.label for k, _ in attrs)
        self.nodes.append(Node(tag, self.here, self.nodes[self.here].depth + 1, words, main))
        self.nodes[self.here].children.append(len(self.nodes) - 1)
        self.here = len(self.nodes) - 1

    def _open(self, tag: str, node: int | None) -> None:
        self.places[tag].append(len(self.open))
        if node is not None:
            self.nested.append(len(self.open))
        self.open.append((tag, node))

    def _pop_to(self, k: int) -> None:
        """Close the open elements from place k on."""
        if self.nested and self.nested[-1] >= k:
            self._end_block()
        while len(self.open) > k:
            tag, node = self.open.pop()
            self.places[tag].pop()
            self.links -= tag == "a"
            if node is not None:
                self.nested.pop()
                self.here = self.nodes[node].parent

    def _innermost(self, tags: tuple) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def _close_open(self, tags: tuple, bounds: tuple) -> None:
        k = self._innermost(tags)
        if k > self._innermost(bounds):
            self._pop_to(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._end_block()
            return
        if tag == "html":
            return
        if tag in BLOCKS:
            self._end_block()
            self._close_open(("p",), ("table", "td", "th", "button", "object"))
        if tag in SIBLINGS:
            self._close_open(SIBLINGS[tag], BOUNDS[tag])
        if tag in BLOCKS or tag in HIDDEN:
            if tag in HIDDEN:
                self._end_block()
            self._push(tag, attrs)
            self._open(tag, self.here)
        else:
            self._open(tag, None)
            self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing on other than void elements

    def handle_endtag(self, tag: str) -> None:
        k = self._innermost((tag,))
        if k >= 0 and (tag in BLOCKS or not self.nested or k >= self.nested[-1]):  # an inline end tag does not close a block
            self._pop_to(k)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in HIDDEN:
            return
        self.text.append(data)
        if self.links > 0:
            self.nodes[self.here].link_chars += len(data)


MEASURES = ["depth", "level", "texts", "log_chars", "log_all", "share", "links", "all_links", "density", "marks", "own_side", "own_main", "above_side", "above_main", "inside_side",
            "siblings", "alike", "place", "first", "rest", "tag", "parent_tag", "above_article", "above_nav", "children", "paragraphs"]
_NAVIGATION = frozenset("nav header footer aside form".split())


def measures(page: Page) -> np.ndarray:
    """One row a node, columns as in MEASURES. Subtree sums go up once, properties of ancestors down once."""
    nodes = page.nodes
    n = len(nodes)
    chars, links, texts, marks = ([getattr(x, k) for x in nodes] for k in ("chars", "link_chars", "texts", "marks"))
    size, side, paragraphs = [1] * n, [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        node = nodes[k]
        p = node.parent
        chars[p] += chars[k]
        links[p] += links[k]
        texts[p] += texts[k]
        marks[p] += marks[k]
        size[p] += size[k]
        paragraphs[p] += paragraphs[k] + (node.tag == "p")
        side[p] += side[k] + bool(node.words & SIDE_WORDS or node.tag in _NAVIGATION)
    total, seen = max(1, chars[0]), 0
    alike = [Counter(nodes[c].tag for c in node.children) for node in nodes]
    out: list[tuple] = []
    above: list[tuple] = []
    for k, node in enumerate(nodes):
        p = max(0, node.parent)
        a = above[p] if k else (0, 0, 0, 0)
        own_side, own_main = len(node.words & SIDE_WORDS), len(node.words & MAIN_WORDS)
        above.append((a[0] + own_side, a[1] + own_main, a[2] + (node.tag in ("article", "main")), a[3] + (node.tag in _NAVIGATION)))
        before, family = seen, nodes[p].children
        seen += node.chars
        same = alike[p][node.tag] / len(family) if k else 1.0
        out.append((node.depth, size[k], texts[k], log1p(node.chars), log1p(chars[k]), chars[k] / total, node.link_chars / max(1, node.chars),
                    links[k] / max(1, chars[k]), chars[k] / size[k], marks[k] / max(1, chars[k]), own_side, own_main, a[0], a[1], side[k] / size[k],
                    len(family), same, before / total, bool(k) and k == family[0], max(0, total - before - chars[k]) / total,
                    _TAG.get(node.tag, len(TAGS) - 1), _TAG.get(nodes[p].tag, len(TAGS) - 1), a[2], a[3], len(node.children), paragraphs[k]))
    return np.array(out, float)
