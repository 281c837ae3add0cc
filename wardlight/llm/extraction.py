"""Main text of web pages by boosted trees over DOM nodes and a decoding of the whole tree.

Two models judge each block node from its measures (subtree density, link density,
attribute words, depth, siblings, place): whether it belongs to the main text, and
whether it only wraps main text. The decoding picks the states of all nodes with the
best sum of log-probabilities under which no choice contradicts another: below a part
that is left out everything is left out, below main text nothing is a wrapper.

No labels come with the pages, so the models are fitted on pages that a generator
builds in many layouts, with labels, from words of a bounded sample of the table.

A null or empty html has an empty text. Broken markup closes as browsers close it. A
row without page_id is extracted like any other; repeated rows give repeated results;
an empty table gives no rows. Only page_id, url and html are read.
"""

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .dom import HIDDEN, Page, measures

#: Pages whose words the generator uses, words of each, and pages that it builds.
SAMPLE, SAMPLE_WORDS, BUILT = 200, 300, 500
LABEL = "data-label"
#: Block nodes that are judged at once.
JUDGED = 50_000


class Builder:
    """Pages in many layouts; main-text elements carry the label attribute, wrappers another value of it."""

    def __init__(self, words: list[str], seed: int = 7):
        self.words, self.random = words or ["text"], random.Random(seed)

    def text(self, low: int, high: int) -> str:
        r = self.random
        line = " ".join(r.choice(self.words) for _ in range(r.randint(low, high)))
        return line.replace("&", "&amp;").replace("<", "&lt;") + r.choice([".", ".", ".", "", "!", "?"])

    def some(self, *choices: str, chance: float = 0.5) -> str:
        return self.random.choice(choices) if self.random.random() < chance else ""

    def element(self, tag: str, inner: str, names: str = "", main: bool = False) -> str:
        key = self.random.choice(["class", "class", "id"])
        attrs = (f' {key}="{names}"' if names else "") + (f" {LABEL}" if main else "")
        return f"<{tag}{attrs}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        return "".join(self.element("li", f'<a href="/{k}">{self.text(1, 2)}</a>') for k in range(n))

    def paragraph(self) -> str:
        r, kind = self.random, self.random.random()
        inner = self.text(1, 6) if r.random() < 0.3 else self.text(5, r.choice([20, 60, 200]))
        if r.random() < 0.15:
            inner = f"{inner} <a href='/x'>{self.text(1, 3)}</a> {self.text(1, 20)}"
        if kind < 0.12:
            return f"<p {LABEL}><b>{inner}<br>"  # never closed
        if kind < 0.2:
            return self.element("div", inner, main=True)
        return self.element("p", inner, main=True)

    def passage(self) -> str:
        r = self.random
        kind = r.random()
        if kind < 0.75:
            return self.paragraph()
        if kind < 0.83:
            return self.element(r.choice(["h2", "h3"]), self.text(1, 8), main=True)
        if kind < 0.89:
            return self.element(r.choice(["ul", "ol"]), "".join(self.element("li", self.text(1, 25), main=True) for _ in range(r.randint(1, 8))), main=True)
        if kind < 0.93:
            return self.element("blockquote", self.paragraph(), main=True)
        if kind < 0.96:
            return self.element("figure", self.element("figcaption", self.text(2, 15), main=True), main=True)
        return self.element("section", "".join(self.paragraph() for _ in range(r.randint(1, 5))), main=True)

    def side(self, where: str) -> str:
        """A part that is not main text, as found before, after, beside or within it."""
        r = self.random
        if where == "before":
            kind = r.choice(["nav", "menu", "header", "ad", "notice", "crumbs", "sidebar", "script"])
        elif where == "within":
            kind = r.choice(["ad", "share", "related", "form", "script", "sidebar"])
        else:
            kind = r.choice(["footer", "comments", "comments", "related", "form", "ad", "sidebar", "script", "notice"])
        text = self.text(3, r.choice([8, 15, 40]))
        if kind == "nav":
            return self.element("nav", self.element("ul", self.links(r.randint(2, 9))), self.some("menu", "navbar"))
        if kind == "menu":
            return self.element("div", self.element("ul", self.links(r.randint(2, 9))), self.some("menu", "nav", "navigation", chance=0.7))
        if kind == "crumbs":
            return self.element("div", " / ".join(f"<a href='/'>{self.text(1, 2)}</a>" for _ in range(3)), self.some("breadcrumbs", "breadcrumb", chance=0.8))
        if kind == "header":
            return self.element("header", self.element("div", text) + self.some("<nav><a href='/'>x</a></nav>"), self.some("header", "masthead", "site-header"))
        if kind == "ad":
            return self.element(r.choice(["div", "div", "aside"]), r.choice([text, self.element("p", text)]), r.choice(["ad", "ads", "advert", "banner", "sponsored", "ad-box", "promo"]))
        if kind == "notice":
            return self.element("div", r.choice([text, self.element("p", text)]) + self.some("<button>OK</button>"), r.choice(["cookie-notice", "cookie", "consent", "notice", "gdpr banner", "modal"]))
        if kind == "sidebar":
            inner = self.element("h3", self.text(1, 3)) + r.choice([self.element("p", text), self.element("ul", self.links(4)), self.element("p", text) + self.element("p", self.text(3, 40))])
            return self.element(r.choice(["aside", "aside", "div"]), inner, r.choice(["sidebar", "widget", "sidebar related"]))
        if kind == "share":
            return self.element("div", self.element("ul", self.links(3)), r.choice(["share", "social", "sharing"]))
        if kind == "related":
            return self.element(r.choice(["div", "section", "aside"]), self.element("h3", self.text(1, 3)) + self.element("ul", self.links(r.randint(2, 6))), r.choice(["related", "related-posts", "widget"]))
        if kind == "form":
            return self.element("form", self.element("label", self.text(1, 3)) + "<input>" + self.some("<select><option>a<option>b</select>") + self.element("p", text), self.some("newsletter", "subscribe", "login"))
        if kind == "comments":
            one = [self.element(r.choice(["div", "li", "article"]), self.element("p", self.text(3, r.choice([20, 80]))) + self.some("<a href='/r'>reply</a>"), r.choice(["comment", "comment", "reply", ""])) for _ in range(r.randint(1, 6))]
            return self.element(r.choice(["section", "div", "ol"]), self.element("h3", self.text(1, 3)) + "".join(one), r.choice(["comments", "comments", "comment-list", "disqus", "responses replies"]))
        if kind == "script":
            return r.choice(["<script>var t='<p>';</script>", "<style>p{margin:0}</style>", "<noscript>x y z</noscript>"])
        return self.element("footer", r.choice([f"&copy; {text}", self.element("p", text) + self.element("ul", self.links(3))]), self.some("footer", "legal"))

    def page(self) -> str:
        r = self.random
        inner = self.element("h1", self.text(1, 10), main=True) if r.random() < 0.8 else ""
        for _ in range(r.choice([1, 2, 3, 6, 12, 25])):
            inner += self.passage()
            if r.random() < 0.06:
                inner += self.side("within")
        tag, names = r.choice([("article", ""), ("article", "post"), ("article", "entry"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "post-body"),
                               ("div", "article-body"), ("section", "main-content"), ("div", "entry-content story"), ("td", "content")])
        if r.random() < 0.2 and tag != "td":
            inner = self.element("div", inner, self.some("body", "text"), main=True)
        body = self.element(tag, inner, names, main=True)
        if tag == "td":
            body = f"<table><tr><td class='menu'>{self.element('ul', self.links(4))}</td>{body}</tr></table>"
        before = "".join(self.side("before") for _ in range(r.randint(0, 4)))
        after = "".join(self.side("after") for _ in range(r.randint(0, 4)))
        if r.random() < 0.5:
            body = self.element(r.choice(["div", "div", "main", "section"]), self.some(self.side("before")) + body + self.some(self.side("after")), self.some("page", "container", "wrapper", "content-wrap"))
        whole = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{self.text(2, 10)}</title></head><body>{before}{body}{after}</body></html>"
        return whole[:whole.rfind("</body>")] if r.random() < 0.2 else whole


class Models:
    def __init__(self, main: trees.Boosted, wrap: trees.Boosted):
        self.main, self.wrap = main, wrap


def labels(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Whether each node is main text, and whether it wraps some without being it."""
    main = np.array([n.main for n in page.nodes])
    wrap = np.zeros(len(main), bool)
    for k in range(len(main) - 1, 0, -1):
        if main[k] or wrap[k]:
            wrap[page.nodes[k].parent] = True
    return main, wrap & ~main


def fit(words: list[str], built: int = BUILT, seed: int = 7) -> Models:
    builder, x, main, wrap = Builder(words, seed), [], [], []
    for _ in range(built):
        page = Page(builder.page(), LABEL)
        a, b = labels(page)
        x.append(measures(page))
        main.append(a)
        wrap.append(b)
    rows = np.concatenate(x)
    return Models(trees.fit(rows, np.concatenate(main).astype(float)), trees.fit(rows, np.concatenate(wrap).astype(float)))


def sample_words(pages: DataFrame, sample: int = SAMPLE, words: int = SAMPLE_WORDS) -> list[str]:
    """At most ``sample`` times ``words`` words of pages chosen by hash; used for fitting only."""
    plain = F.regexp_replace(F.col("html"), r"<[^>]*>|&\w+;", " ")
    key = F.xxhash64("page_id", "html")
    # hashes alone are ordered, so that tasks send numbers and not pages to the driver
    chosen = [r[0] for r in pages.where("html IS NOT NULL").select(key.alias("key")).distinct().orderBy("key").limit(sample).collect()]
    rows = pages.where(key.isin(chosen)).dropDuplicates(["page_id", "html"]).select(F.slice(F.split(plain, r"\s+"), 1, words)).collect() if chosen else []
    return [w for r in sorted(r[0] for r in rows) for w in r if w and "<" not in w]


def decode(page: Page, main: np.ndarray, wrap: np.ndarray) -> str:
    """Blocks of the nodes that are main text under the best consistent states (left out, wrapper, main)."""
    nodes = page.nodes
    m, w = main.clip(-12, 12), wrap.clip(-12, 12)
    out = (-np.logaddexp(0, m) - np.logaddexp(0, w)).tolist()
    own = (-np.logaddexp(0, -w)).tolist(), (-np.logaddexp(0, -m)).tolist()
    best = [[o, a, b] for o, a, b in zip(out, *own, strict=True)]
    for k in range(len(nodes) - 1, 0, -1):
        if nodes[k].tag in HIDDEN or nodes[k].tag == "head":
            best[k][1] = best[k][2] = -1e9
        o, a, b = best[k]
        up = best[nodes[k].parent]
        up[0] += o
        up[1] += max(o, a, b)
        up[2] += max(o, b)
    state = [0] * len(nodes)
    for k, (o, a, b) in enumerate(best):
        above = state[nodes[k].parent] if k else 1
        if above == 1:
            state[k] = 1 if a >= max(o, b) else 2 if b >= o else 0
        elif above == 2:
            state[k] = 2 if b >= o else 0
    return "\n\n".join(text for k, text in page.blocks if state[k] == 2)


def texts(pages: list[str], models: Models) -> list[str]:
    """Main texts, judging the nodes of several pages at once."""
    found: list[str] = []
    held: list[tuple[Page, np.ndarray]] = []

    def judge() -> None:
        rows = np.concatenate([x for _, x in held])
        main, wrap, k = models.main.logit(rows), models.wrap.logit(rows), 0
        for page, x in held:
            found.append(decode(page, main[k:k + len(x)], wrap[k:k + len(x)]))
            k += len(x)
        held.clear()

    n = 0
    for html in pages:
        page = Page(html)
        held.append((page, measures(page)))
        n += len(page.nodes)
        if n > JUDGED:
            judge()
            n = 0
    if held:
        judge()
    return found


def extract(pages: DataFrame, models: Models) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    shared = pages.sparkSession.sparkContext.broadcast(models)  # 120 trees of 31 nodes

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                found = texts(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")
