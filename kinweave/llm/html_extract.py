"""HTML extraction with a tree-structured graphical model over the DOM.

A page is parsed into its block elements; inline elements belong to the block around them. Each block is a
binary variable, content or not. Its own potential is a weighted sum of features (tag, words of class, id
and role, length, links, punctuation, place); each parent-child pair has a potential per pair of states
and per group of child tags. Sum-product messages go up from the leaves and down from the root once each, which
gives the exact marginals of a tree. A block's text is part of the article if its marginal is at least
one half. The weights are trained on labelled pages by gradient ascent on their likelihood, for which the
same messages give the expected features.

``labelled_pages`` makes the training pages: TRAINING_PAGES pages in several layouts, from a fixed seed, with
a label per block; ``train`` takes any others.

Defined cases: a null or empty page gives an empty text; pages cut off anywhere, tags never closed and stray
end tags are read as far as they go; character references are decoded as in HTML 5; white space is what
Unicode calls so; pages of any length and depth are read whole, without recursion; repeated rows are read
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html as html_lib
import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.shared import arrow_map, table

TRAINING_PAGES = 240
EPOCHS = 12

# Element names by their part in a page.
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption header footer nav aside form fieldset "
    "details summary address center menu dialog hgroup search noscript select button iframe".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is not text of the page.
DROPPED = frozenset("script style template svg math head title object audio video canvas textarea option".split())
#: Of these, the inside is not markup.
RAW = frozenset("script style title textarea".split())
ENDS_PARAGRAPH = BLOCKS - frozenset(["select", "button", "iframe", "noscript"])
#: A start tag of the key ends an open element of the values, up to the elements in SCOPE.
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl table menu body html article section main div aside nav header footer form".split())

KEYWORDS = (
    ("nav", re.compile(r"nav|menu|breadcrumb|crumb|pagination|pager|toolbar|tabs?\b|skip|toc\b|topbar")),
    ("ad", re.compile(r"\bads?\b|\bad[-_]|[-_]ads?\b|advert|sponsor|promo|banner|dfp|taboola|outbrain|affiliate")),
    ("footer", re.compile(r"foot|copyright|legal|colophon|imprint|impressum")),
    ("header", re.compile(r"head(?!line)|masthead|logo|brand|site-?title|hero")),
    ("side", re.compile(r"side|aside|widget|rail|related|recommend|popular|trending|more-?(?:stories|posts)|teaser|tag-?cloud|archive")),
    ("comment", re.compile(r"comment|disqus|respon[ds]|repl(?:y|ies)|discussion|feedback|review|guestbook")),
    ("share", re.compile(r"share|social|follow|tweet|facebook|meta\b|byline|author|tags?\b")),
    ("notice", re.compile(r"notice|cookie|consent|gdpr|alert|popup|modal|overlay|message|warning|paywall|disclaimer|announce")),
    ("form", re.compile(r"form|search|subscribe|newsletter|login|sign-?(?:in|up)|register|poll|survey|contact|input")),
    ("content", re.compile(r"content|article|post(?!s)|entry|story|main|body|text|page|blog|prose|paragraph|copy\b")),
)
_TAG_GROUPS = {
    "article": "article", "main": "article", "p": "p", "blockquote": "p", "pre": "p", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "hgroup": "heading",
    "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "item", "dt": "item", "dd": "item", "nav": "nav", "header": "header", "footer": "footer", "address": "footer", "aside": "aside", "dialog": "aside",
    "form": "form", "fieldset": "form", "select": "form", "button": "form", "search": "form", "noscript": "form", "iframe": "form",
    "table": "table", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "table", "th": "table", "caption": "table", "figure": "figure", "figcaption": "figure", "html": "root", "body": "root",
}
TAG_GROUPS = (*dict.fromkeys(_TAG_GROUPS.values()), "div")


@dataclass
class Block:
    tag: str
    parent: int
    names: str = ""
    depth: int = 0
    text_chars: int = 0
    link_chars: int = 0
    marks: int = 0
    order: int = 0
    all_chars: int = 0
    all_links: int = 0


@dataclass
class Page:
    blocks: list[Block]
    #: (block, text) in page order; inside one of them no block begins or ends.
    pieces: list[tuple[int, str]] = field(default_factory=list)


_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


def _tag_end(html: str, at: int, last_quote: dict[str, int]) -> int:
    """Where the tag at ``at`` ends, after its '>'; the end of the page if it doesn't."""
    end = html.find(">", at)
    if end < 0:
        return len(html)
    if html.find('"', at, end) < 0 and html.find("'", at, end) < 0:
        return end + 1
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.end()
        if m.start() >= last_quote[m[0]]:
            at = m.end()
        else:
            at = html.index(m[0], m.end()) + 1
    return len(html)


def parse(html: str) -> Page:
    blocks = [Block("html", -1)]
    page = Page(blocks)
    stack: list[tuple[str, int]] = [("html", 0)]
    opened: dict[str, int] = {"html": 1}
    last_quote = {q: html.rfind(q) for q in "\"'"}
    held: list[str] = []
    links = 0
    at, size, lower = 0, len(html), None

    def flush() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                page.pieces.append((stack[-1][1], text))

    def add(raw: str) -> None:
        held.append(raw)
        block = blocks[stack[-1][1]]
        chars = len(raw) - raw.count(" ")
        block.text_chars += chars
        block.marks += raw.count(".") + raw.count(",") + raw.count("!") + raw.count("?")
        if links:
            block.link_chars += chars

    def pop() -> None:
        tag, _ = stack.pop()
        opened[tag] -= 1

    while at < size:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        if start > at:
            add(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        m = _NAME.match(html, start)
        if not m:
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                end = html.find(">", start)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = start + 1
            continue
        tag, closing = m[1].lower(), html[start + 1] == "/"
        end = _tag_end(html, m.end(), last_quote)
        inside, at = html[m.end() : end - 1], end
        if tag in DROPPED:
            if closing:
                continue
            flush()
            if tag in RAW or tag not in ("head", "option"):
                lower = html.lower() if lower is None else lower
                stop = lower.find(f"</{tag}", at)
                if stop < 0 and tag not in RAW:
                    continue
                at = size if stop < 0 else _tag_end(html, stop + 2, last_quote)
            continue
        if tag == "br" or tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag not in BLOCKS:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1)) if closing or not inside.rstrip().endswith("/") else links
            continue
        flush()
        if closing:
            if tag != "html" and opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
                links = 0
            continue
        if tag == "html" or (tag == "body" and opened.get("body")):
            continue
        if tag in ENDS_PARAGRAPH and opened.get("p") and stack[-1][0] == "p":
            pop()
        ends = IMPLIED_END.get(tag, ())
        while ends and len(stack) > 1 and (stack[-1][0] in ends or (stack[-1][0] not in SCOPE and any(opened.get(e) for e in ends))):
            pop()
        names = " ".join((a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(inside) if a[1].lower() != "data-label").lower() if "=" in inside else ""
        blocks.append(Block(tag, stack[-1][1], names, len(stack), order=len(blocks)))
        links = 0
        stack.append((tag, len(blocks) - 1))
        opened[tag] = opened.get(tag, 0) + 1
        if inside.endswith("/") and tag in ("iframe",):
            pop()
    flush()
    for block in reversed(blocks):
        block.all_chars += block.text_chars
        block.all_links += block.link_chars
        if block.parent >= 0:
            blocks[block.parent].all_chars += block.all_chars
            blocks[block.parent].all_links += block.all_links
    return page


def _bucket(value: float, bounds: Sequence[float]) -> int:
    return bisect.bisect_right(bounds, value)


_LENGTHS, _SHARES, _DENSITY = (1, 25, 80, 200, 600), (0.05, 0.3, 0.7), (0.01, 0.3, 0.7)
FEATURES = (
    *(f"tag:{t}" for t in TAG_GROUPS), *(f"name:{k}" for k, _ in KEYWORDS), "name:none",
    *(f"own:{i}" for i in range(6)), *(f"all:{i}" for i in range(6)), *(f"links:{i}" for i in range(4)), *(f"share:{i}" for i in range(4)), *(f"depth:{i}" for i in range(4)), *(f"marks:{i}" for i in range(3)), "bias",
)
_INDEX = {name: i for i, name in enumerate(FEATURES)}


@functools.lru_cache(maxsize=4096)
def _name_features(names: str) -> tuple[int, ...]:
    found = tuple(_INDEX[f"name:{k}"] for k, pattern in KEYWORDS if pattern.search(names)) if names else ()
    return found or (_INDEX["name:none"],)


def features(page: Page) -> list[list[int]]:
    """Feature indexes of each block."""
    whole, out = max(1, page.blocks[0].all_chars), []
    for b in page.blocks:
        marks = 0 if b.text_chars < 20 else 1 + (b.marks * 120 >= b.text_chars)
        out.append(
            [
                _INDEX[f"tag:{_TAG_GROUPS.get(b.tag, 'div')}"], *_name_features(b.names), _INDEX["own:0"] + _bucket(b.text_chars, _LENGTHS), _INDEX["all:0"] + _bucket(b.all_chars, _LENGTHS),
                _INDEX["links:0"] + _bucket(b.all_links / max(1, b.all_chars), _DENSITY), _INDEX["share:0"] + _bucket(b.all_chars / whole, _SHARES), _INDEX["depth:0"] + _bucket(b.depth, (2, 4, 7)), _INDEX["marks:0"] + marks, _INDEX["bias"],
            ]
        )
    return out


@dataclass
class TreeModel:
    #: Weight of each feature for the state "content".
    node: np.ndarray
    #: Log potential of (child's tag group, parent's state, child's state).
    edge: np.ndarray

    def scores(self, found: list[list[int]]) -> list[float]:
        weights = self.node.tolist()
        return [sum(weights[i] for i in row) for row in found]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(parents: Sequence[int], groups: Sequence[int], scores: Sequence[float], edge: Sequence) -> tuple[list[float], list[list[float]]]:
    """Sum-product on a tree whose parents come before their children.

    Returns P(content) of each node, and for each node but the root the four joint probabilities with its
    parent, in the order (parent, child) = 00, 01, 10, 11.
    """
    n = len(parents)
    # Upward: what a node's subtree says about the node, and the message it sends to its parent.
    below = [[0.0, s] for s in scores]
    sent = [(0.0, 0.0)] * n
    for k in range(n - 1, 0, -1):
        (e00, e01), (e10, e11) = edge[groups[k]]
        b0, b1 = below[k]
        up = (_log_add(e00 + b0, e01 + b1), _log_add(e10 + b0, e11 + b1))
        sent[k] = up
        at = below[parents[k]]
        at[0] += up[0]
        at[1] += up[1]
    # Downward: what the rest of the tree says.
    belief = below
    first, joint = [0.0] * n, [[0.0] * 4 for _ in range(n)]
    for k in range(n):
        if k:
            (e00, e01), (e10, e11) = edge[groups[k]]
            p0, p1 = belief[parents[k]][0] - sent[k][0], belief[parents[k]][1] - sent[k][1]
            b0, b1 = below[k]
            four = (p0 + e00 + b0, p0 + e01 + b1, p1 + e10 + b0, p1 + e11 + b1)
            top = max(four)
            four = [math.exp(x - top) for x in four]
            total = sum(four)
            joint[k] = [x / total for x in four]
            belief[k] = [_log_add(p0 + e00, p1 + e10) + b0, _log_add(p0 + e01, p1 + e11) + b1]
        first[k] = 1 / (1 + math.exp(min(700.0, belief[k][0] - belief[k][1])))
    return first, joint


_GROUP_OF = {t: i for i, t in enumerate(TAG_GROUPS)}


def _groups(page: Page) -> list[int]:
    return [_GROUP_OF[_TAG_GROUPS.get(b.tag, "div")] for b in page.blocks]


def content_marginals(page: Page, model: TreeModel) -> list[float]:
    return marginals([b.parent for b in page.blocks], _groups(page), model.scores(features(page)), model.edge.tolist())[0]


def extract(html: str, model: TreeModel) -> str:
    """The article's text."""
    page = parse(html)
    if not page.pieces:
        return ""
    content = content_marginals(page, model)
    return " ".join(text for block, text in page.pieces if content[block] >= 0.5)


def train(pages: Sequence[tuple[str, Sequence[int]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> TreeModel:
    """Fit to (html, label of each block in page order) by stochastic gradient ascent (AdaGrad) on the log likelihood."""
    model = TreeModel(np.zeros(len(FEATURES)), np.zeros((len(TAG_GROUPS), 2, 2)))
    seen_node, seen_edge = np.full_like(model.node, 1e-2), np.full_like(model.edge, 1e-2)
    ready = []
    for html, labels in pages:
        page = parse(html)
        if len(labels) != len(page.blocks):
            raise ValueError(f"{len(page.blocks)} blocks, {len(labels)} labels")
        ready.append(([b.parent for b in page.blocks], _groups(page), features(page), list(labels)))
    for _ in range(epochs):
        for parents, groups, found, labels in ready:
            first, joint = marginals(parents, groups, model.scores(found), model.edge.tolist())
            node, edge = -decay * model.node, -decay * model.edge
            for k, row in enumerate(found):
                node[row] += labels[k] - first[k]
                if k:
                    edge[groups[k], labels[parents[k]], labels[k]] += 1
                    edge[groups[k]] -= np.reshape(joint[k], (2, 2))
            seen_node += node**2
            seen_edge += edge**2
            model.node += rate * node / np.sqrt(seen_node)
            model.edge += rate * edge / np.sqrt(seen_edge)
    return model


class _Maker:
    """Labelled pages in several layouts. Blocks carry their label as data-label, which the parser doesn't show the model."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("bcdfglmnprstv") + self.r.choice("aeiouéü") for _ in range(1)) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        mark = self.r.choice(["", "", "", "", "***", "!!", "&amp;&amp;", "|"])
        return " ".join(" ".join(w + mark for w in self.words(1, 22).capitalize().split()) + self.r.choice([".", ".", ".", ",", "?", ""]) for _ in range(self.r.randint(low, high)))

    def tag(self, name: str, label: int, inner: str, names: str = "") -> str:
        attributes = f' {self.r.choice(["class", "class", "id"])}="{names}"' if names else ""
        return f'<{name}{attributes} data-label="{label}">{inner}</{name}>'

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 3)}</a>'

    def links(self, label: int = 0) -> str:
        return self.tag("ul", label, "".join(self.tag("li", label, self.link()) for _ in range(self.r.randint(2, 8))))

    def noise(self, kind: str) -> str:
        r, t = self.r, self.tag
        text = lambda: r.choice([self.words(1, 6), self.sentences(1, 2), self.sentences(1, 4)])
        para = lambda: r.choice([text(), t("p", 0, text()), t("p", 0, text()) + t("p", 0, text()), t("h3", 0, self.words(1, 4)) + t("p", 0, text())])
        if kind == "nav":
            return t(r.choice(["nav", "nav", "div", "ul"]), 0, r.choice([self.links(), " ".join(self.link() for _ in range(6))]), r.choice(["", "menu", "main-nav", "navbar", "breadcrumbs"]) or "nav") if r.random() < 0.6 else t("nav", 0, self.links())
        if kind == "ad":
            return t(r.choice(["div", "div", "aside", "section"]), 0, para(), r.choice(["ad", "ads", "ad-slot", "advert", "advertisement", "sponsored", "promo", "banner-ad"]))
        if kind == "header":
            return t("header", 0, r.choice([self.words(1, 4), t("h1", 0, self.words(1, 3)), t("div", 0, self.words(1, 4), "logo") + self.links(), text(), t("p", 0, text())])) if r.random() < 0.7 else t("div", 0, para(), r.choice(["site-header", "masthead", "header", "top-header"]))
        if kind == "footer":
            return t("footer", 0, "&copy; " + r.choice([text(), self.links(), t("p", 0, text())])) if r.random() < 0.7 else t("div", 0, "&copy; " + para(), r.choice(["footer", "site-footer", "page-footer", "copyright"]))
        if kind == "side":
            return t("aside", 0, para() + (self.links() if r.random() < 0.5 else ""), r.choice(["", "", "sidebar", "related"])) if r.random() < 0.6 else t("div", 0, para() + self.links(), r.choice(["sidebar", "related-posts", "widget", "side", "popular", "recommended"]))
        if kind == "comment":
            one = lambda: t(r.choice(["div", "li", "p", "article"]), 0, r.choice([text(), t("p", 0, self.sentences(1, 5))]), r.choice(["comment", "comment-body", "reply", ""]))
            return t(r.choice(["section", "div", "ol", "ul"]), 0, (t("h3", 0, self.words(1, 2)) if r.random() < 0.5 else "") + "".join(one() for _ in range(r.randint(1, 5))), r.choice(["comments", "comment-list", "reader-comments", "responses", "disqus", "discussion"]))
        if kind == "notice":
            return t(r.choice(["div", "section", "aside", "p", "dialog"]), 0, text(), r.choice(["notice", "cookie-notice", "cookie-banner", "alert", "consent", "popup", "site-notice", "gdpr"]))
        if kind == "form":
            return t("form", 0, r.choice(["<label>" + self.words(1, 3) + "</label><input name=q>", text() + t("button", 0, self.words(1, 2)), t("p", 0, text()) + "<input type=text>"]), r.choice(["", "search", "newsletter", "login"]))
        return t("div", 0, " ".join(self.link() for _ in range(4)), r.choice(["share", "social", "tags", "meta"]))

    def article(self) -> str:
        r, t, parts = self.r, self.tag, []
        if r.random() < 0.85:
            parts.append(t(r.choice(["h1", "h1", "h2"]), 1, self.words(1, 10)))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            kind = r.random()
            if kind < 0.68:
                inner = self.sentences(1, 6)
                if r.random() < 0.3:
                    inner = f"<b>{inner}<br>" if r.random() < 0.5 else inner + f' <em>{self.words(1, 2)}</em> <a href="/x">{self.words(1, 2)}</a>.'
                parts.append(t("p", 1, inner))
            elif kind < 0.75:
                parts.append(t(r.choice(["h2", "h3"]), 1, self.words(1, 6)))
            elif kind < 0.82:
                parts.append(t(r.choice(["ul", "ol"]), 1, "".join(t("li", 1, r.choice([self.words(1, 8), self.sentences(1, 2)])) for _ in range(r.randint(1, 5)))))
            elif kind < 0.87:
                parts.append(t("blockquote", 1, r.choice([self.sentences(1, 3), t("p", 1, self.sentences(1, 3))])))
            elif kind < 0.90:
                parts.append(t("table", 1, "".join(t("tr", 1, "".join(t("td", 1, self.words(1, 4)) for _ in range(3))) for _ in range(r.randint(1, 4)))))
            elif kind < 0.93:
                parts.append(t("pre", 1, self.words(3, 20)))
            elif kind < 0.96:
                parts.append(t("figure", 1, "<img src=x>" + t("figcaption", 1, self.words(2, 10))))
            else:
                parts.append(t("section", 1, t("h2", 1, self.words(1, 4)) + t("p", 1, self.sentences(1, 5))))
            if r.random() < 0.12:
                parts.append(self.noise(r.choice(["ad", "share", "notice", "form", "side", "nav"])))
        inner = "".join(parts) or t("p", 1, self.words(1, 5))
        kind = r.random()
        if kind < 0.55:
            return t("article", 1, inner, r.choice(["", "", "", "post", "entry"]))
        if kind < 0.7:
            return t("main", 1, t("article", 1, inner) if r.random() < 0.5 else inner)
        if kind < 0.9:
            return t("div", 1, inner, r.choice(["content", "post-content", "article-body", "entry-content", "story", "main-content", "text"]))
        return t("main", 1, t("div", 1, inner, r.choice(["content", "post", ""])))

    def page(self) -> str:
        r, kinds = self.r, ["nav", "ad", "header", "footer", "side", "comment", "notice", "form", "share"]
        before = [self.noise(r.choice(["nav", "header", "notice", "ad", "form", "side"])) for _ in range(r.randint(0, 4))]
        after = [self.noise(r.choice(kinds)) for _ in range(r.randint(0, 4))]
        if r.random() < 0.6:
            before.insert(0, self.noise("nav"))
        if r.random() < 0.7:
            after.append(self.noise("footer"))
        body = "".join([*before, self.article(), *after])
        if r.random() < 0.25:
            body = self.tag("div", 0, body, r.choice(["", "wrapper", "container", "page"]))
        if r.random() < 0.12:
            # A fragment: no body element, and often nothing around the article.
            return r.choice([self.article(), self.article(), body])
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        return f'{head}<body data-label="0">{body}</body></html>'


_LABEL = re.compile(r' data-label="([01])"')


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[str, list[int]]]:
    """(html, label of each block, the root's first): pages made from a fixed seed."""
    maker, out = _Maker(seed), []
    for _ in range(n):
        html = maker.page()
        # Block start tags stand in the order of the blocks; all but the root carry a label.
        out.append((_LABEL.sub("", html), [0, *map(int, _LABEL.findall(html))]))
    return out


@functools.lru_cache(maxsize=1)
def default_model() -> TreeModel:
    return train(labelled_pages())


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or default_model()

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts = [extract(h or "", model) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html"), kernel, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
