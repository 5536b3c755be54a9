"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is read into a tree of its block elements; text that stands beside block
elements (in the body, say) is a node of its own. Each node gets features:
tokens of its tag, class, id and role and of those of its ancestors, both as
hashes, whose weight is learnt, and as words with a known purpose; text and link
density of its subtree, depth, its place among siblings and their sizes. Boosted
regression trees (logistic loss, histogram splits) turn them into log-odds that
the node holds main text.

Decoding is hierarchical: a node can hold main text only if its parent does.
The choice of greatest total log-odds under that rule is found bottom-up, as a
node is worth its own log-odds and those of its worthwhile children. So no
paragraph survives inside a rejected sidebar, and an advert inside an article
goes with all it holds. The page itself holds no text of its own.

The trees are trained on pages of known structure, generated from a seed with
many layouts, class names and text lengths (``training_pages``); ``n_pages``
bounds that sample.

Defined cases: null and empty html give an empty text, as do pages without main
text. Unclosed and misnested tags are repaired as browsers do in outline. A
page of text without tags is one block. Scripts, styles and other raw text end
at their closing tag, whatever they hold; without one they take the rest of the
page, as in browsers. Unknown elements are inline. A character reference holds
within one run of text: what tags part is no reference. Repeated rows give equal
texts. A page of any size is read whole, one at a time; an empty table gives no
rows. A column named like the result is replaced; others stay as they are.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TOKEN = re.compile(r"[a-z]+")

#: Elements whose content is text for no reader, up to the closing tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
    "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements in the flow of a line that are nodes all the same: the text around them stays one block.
INSET = {"audio", "button", "canvas", "noscript", "object", "select", "svg", "template", "video"}
#: An opening tag of the key closes open elements of these names, up to the nearest of the scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html"}

#: Words in class, id and role that say what an element is for.
GROUPS: dict[str, set[str]] = {
    "main": {"article", "post", "entry", "content", "story", "body", "text", "main", "articlebody", "page", "single", "prose", "blog", "news"},
    "menu": {"nav", "navbar", "menu", "navigation", "breadcrumb", "breadcrumbs", "toc", "tabs", "pagination", "pager", "skip", "topbar"},
    "header": {"header", "masthead", "branding", "logo", "banner", "hero", "top"},
    "footer": {"footer", "copyright", "contentinfo", "colophon", "bottom", "legal", "foot"},
    "side": {"sidebar", "aside", "side", "widget", "complementary", "rail", "secondary"},
    "advert": {"ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner", "partner", "advertising"},
    "notice": {"notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "gdpr", "newsletter", "subscribe", "subscription", "paywall", "overlay", "signup", "toast", "warning"},
    "comment": {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "feedback", "commentlist", "reader", "readers"},
    "share": {"share", "social", "related", "recommended", "tags", "meta", "byline", "author", "more", "trending", "popular", "links"},
    "form": {"form", "search", "login", "contact", "register", "input"},
    "unseen": {"hidden", "template", "sr", "offscreen"},
}
NAMES = list(GROUPS)
TAGS: dict[str, str] = {
    "article": "main", "main": "main", "nav": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "menu": "menu",
    "button": "form", "select": "form", "search": "form", "audio": "unseen", "canvas": "unseen", "svg": "unseen", "template": "unseen", "video": "unseen",
}
KINDS = {"p": 1, "h1": 2, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "ul": 4, "ol": 4, "dl": 4, "li": 5, "dt": 5, "dd": 5, "div": 6, "section": 7, "blockquote": 8, "pre": 8, "figure": 9, "figcaption": 9, "table": 10, "tr": 10, "td": 10, "th": 10, "tbody": 10, "#text": 11} | dict.fromkeys(INSET, 12)
#: Attribute tokens by hash, in so many bits; all tokens of two pages may fall together, the trees learn which bits tell.
HASHED = 48


@lru_cache(maxsize=32)
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    bits: int  # by NAMES and by hash, of the element itself
    above: int  # bits of its ancestors
    index: int  # among its siblings
    at: int  # place in the source
    children: list[int] = field(default_factory=list)
    chars: int = 0  # own text, later that of the subtree
    linked: int = 0
    marks: int = 0  # full stops and commas
    blocks: int = 0
    links: int = 0


def attribute_bits(tag: str, attributes: str) -> int:
    """What tag, class, id and role say of an element: a bit for each group of
    NAMES, then one for the hash of each token."""
    bits = 0
    if tag in TAGS:
        bits |= 1 << NAMES.index(TAGS[tag])
    if attributes and "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            for t in TOKEN.findall((m[2] or m[3] or m[4] or "").lower()):
                bits |= 1 << len(NAMES) + zlib.crc32(t.encode()) % HASHED
                for k, name in enumerate(NAMES):
                    if t in GROUPS[name]:
                        bits |= 1 << k
    return bits


class Line:
    """Text of a block as it is read, and how much of it is in links."""

    __slots__ = ("at", "linked", "parts")

    def __init__(self):
        self.at, self.linked, self.parts = -1, 0, []


class Page:
    """The block elements of a page and its blocks of text in page order."""

    def __init__(self, source: str | None):
        self.nodes = [Node("html", -1, 0, 0, 0, 0, 0)]
        self._found: list[tuple[int, int, str, int, int]] = []  # place, node, text, linked, links
        self._bits: dict[tuple[str, str], int] = {}
        self.size = max(1, len(source or ""))
        self._read(source or "")
        self._settle()

    def _settle(self) -> None:
        """Gives text beside block elements a node of its own, and sums up subtrees."""
        nodes = self.nodes
        self.blocks: list[tuple[int, str]] = []
        mixed = set()
        for place, k, text, linked, links in sorted(self._found):
            if k == 0 or any(nodes[c].tag not in INSET for c in nodes[k].children):
                up = nodes[k]
                nodes.append(Node("#text", k, up.depth + 1, 0, up.above | up.bits, 0, place))
                mixed.add(k)
                k = len(nodes) - 1
                nodes[k].links += links
                up.links -= links
            n = nodes[k]
            n.chars += len(text)
            n.linked += min(linked, len(text))
            n.marks += text.count(".") + text.count(",")
            n.blocks += 1
            self.blocks.append((k, text))
        for k in range(1, len(nodes)):
            if nodes[k].tag == "#text":
                nodes[nodes[k].parent].children.append(k)
        for k in mixed:
            nodes[k].children.sort(key=lambda c: nodes[c].at)
            for i, c in enumerate(nodes[k].children):
                nodes[c].index = i
        for k in range(len(nodes) - 1, 0, -1):  # text nodes come last: their parents are summed up after them
            n, up = nodes[k], nodes[nodes[k].parent]
            up.chars += n.chars
            up.linked += n.linked
            up.marks += n.marks
            up.blocks += n.blocks
            up.links += n.links

    def _flush(self, node: int, line: Line, links: int) -> None:
        """Ends a block. links: those that its node has from this block."""
        text = " ".join("".join(line.parts).split()) if line.parts else ""
        if text:
            self._found.append((line.at, node, text, line.linked, links))
        line.parts, line.linked, line.at = [], 0, -1

    def _read(self, source: str) -> None:
        nodes, stack, line, outer = self.nodes, [0], Line(), []  # outer: lines that insets interrupt, their places in the stack, links
        at, anchor, links = 0, 0, 0
        hidden = False  # in the head

        def take(end: int) -> None:
            if end > at and not hidden:
                piece = source[at:end]
                if "&" in piece:
                    piece = html.unescape(piece)
                if line.at < 0 and not piece.isspace():
                    line.at = at
                line.parts.append(piece)
                if anchor:
                    line.linked += len(piece.strip())

        def cut(k: int) -> None:
            """Closes open elements from place k of the stack on. Insets among
            them hand back the line that they interrupt, to go on or to end."""
            nonlocal line, links
            owner, place = stack[-1], len(stack) - 1
            while outer and outer[-1][1] >= k:
                self._flush(owner, line, links)
                line, place, links = outer.pop()
                place -= 1
                owner = stack[place]
            if place >= k:
                self._flush(owner, line, links)
                links = 0
            del stack[k:]

        while m := MARKUP.search(source, at):
            take(m.start())
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag in RAW:
                if not closing and not (attributes.endswith("/") and tag != "script"):
                    end = raw_end(tag).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if tag == "head":
                hidden = not closing
                continue
            if tag in ("html", "body"):
                hidden = False
                continue
            inset = tag in INSET
            if not inset and tag not in BLOCK:
                if tag == "br":
                    line.parts.append(" ")
                elif tag == "hr":
                    self._flush(stack[-1], line, links)
                    links = 0
                elif tag == "a":
                    anchor = 0 if closing else 1
                    nodes[stack[-1]].links += not closing
                    links += not closing
                continue
            if not inset:
                self._flush(stack[-1], line, links)
                links = 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        cut(k)
                        break
                continue
            hidden = False
            if not inset:
                self._close_for(tag, stack, cut)
            up = nodes[stack[-1]]
            key = (tag, attributes)
            if key not in self._bits:
                self._bits[key] = attribute_bits(*key)
            nodes.append(Node(tag, stack[-1], up.depth + 1, self._bits[key], up.above | up.bits, len(up.children), m.start()))
            up.children.append(len(nodes) - 1)
            if not attributes.endswith("/"):
                stack.append(len(nodes) - 1)
                if inset:
                    outer.append((line, len(stack) - 1, links))
                    line, links = Line(), 0
        take(len(source))
        cut(1)
        self._flush(0, line, links)

    def _close_for(self, tag: str, stack: list[int], cut: Callable[[int], None]) -> None:
        if self.nodes[stack[-1]].tag == "p":  # a paragraph holds no block
            cut(len(stack) - 1)
        names = CLOSES.get(tag)
        if names:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = self.nodes[stack[k]].tag
                if open_tag in names:
                    cut(k)
                    return
                if open_tag in SCOPE and not (tag in ("td", "th") and open_tag == "tr"):
                    return

    def features(self) -> list[tuple]:
        """A row for each node but the root."""
        nodes = self.nodes
        total = max(1, nodes[0].chars)
        out = []
        for k in range(1, len(nodes)):
            n = nodes[k]
            up = nodes[n.parent]
            sizes = up.children
            before = nodes[sizes[n.index - 1]].chars if n.index else 0
            after = nodes[sizes[n.index + 1]].chars if n.index + 1 < len(sizes) else 0
            below = len(n.children)
            first = nodes[n.children[0]] if below else None
            out.append((
                n.bits, n.above, KINDS.get(n.tag, 0), n.depth, n.index, len(sizes), n.chars, n.linked / max(1, n.chars), n.links,
                n.marks / max(1, n.chars), n.chars / max(1, n.blocks), n.blocks, n.chars / total, n.chars / max(1, up.chars),
                before, after, below, first.chars if first else 0, up.linked / max(1, up.chars), KINDS.get(up.tag, 0), n.at / self.size,
            ))
        return out


BITS = len(NAMES) + HASHED


def matrix(rows: list[tuple]) -> np.ndarray:
    """Features as numbers: a column for each bit of the element and of its ancestors, and the measures."""
    own, above = (np.fromiter((r[c] for r in rows), np.int64, len(rows)) for c in (0, 1))
    rest = np.array([r[2:] for r in rows], np.float64).reshape(-1, 19)
    bits = np.concatenate([(own[:, None] >> np.arange(BITS)) & 1, (above[:, None] >> np.arange(BITS)) & 1], 1)
    for c in (4, 6, 8, 9, 12, 13, 15):  # sizes, on a log scale
        rest[:, c] = np.log1p(rest[:, c])
    return np.concatenate([bits, rest], 1)


# ---- boosted trees ----


@dataclass
class Boosted:
    """Complete binary trees of one depth in arrays: node i has the children 2i + 1 and 2i + 2."""

    bias: float
    feature: np.ndarray  # tree, inner node
    cut: np.ndarray
    leaf: np.ndarray  # tree, leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Boosted:
        n, d = x.shape
        bits = np.flatnonzero(((x == 0) | (x == 1)).all(0))
        rest = np.setdiff1d(np.arange(d), bits)
        on = np.ascontiguousarray(x[:, bits])
        cuts = {j: np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in rest}
        binned = {j: np.searchsorted(c, x[:, j], "left") for j, c in cuts.items()}  # value > cut goes right
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        bias = float(np.log(share / (1 - share)))
        margin = np.full(n, bias)
        inner = (1 << depth) - 1
        feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            at = np.zeros(n, np.int64)
            for level in range(depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                choice = [(0, np.inf)] * width

                def gain(g, h, gt, ht):
                    return g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)

                for w in range(width if len(bits) else 0):  # all bits of a node's rows in one product
                    own = np.flatnonzero(at == first + w)
                    g, h = grad[own] @ on[own], hess[own] @ on[own]
                    top = gain(g, h, grad[own].sum(), hess[own].sum())
                    k = int(top.argmax())
                    if top[k] > best[w]:
                        best[w], choice[w] = top[k], (bits[k], 0.0)
                for j, c in cuts.items():
                    m = len(c) + 1
                    cell = (at - first) * m + binned[j]
                    g = np.bincount(cell, grad, width * m).reshape(width, m).cumsum(1)
                    h = np.bincount(cell, hess, width * m).reshape(width, m).cumsum(1)
                    each = gain(g, h, g[:, -1:], h[:, -1:])[:, :-1]
                    k = each.argmax(1)
                    top = each[np.arange(width), k]
                    for w in np.flatnonzero(top > best):
                        best[w], choice[w] = top[w], (j, c[k[w]])
                for w, (j, c) in enumerate(choice):
                    feature[t, first + w], cut[t, first + w] = j, c
                right = x[np.arange(n), feature[t, at]] > cut[t, at]
                at = 2 * at + 1 + right
            place = at - inner
            g, h = np.bincount(place, grad, 1 << depth), np.bincount(place, hess, 1 << depth)
            leaf[t] = rate * g / (h + ridge)
            margin += leaf[t, place]
        return cls(bias, feature, cut, leaf)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def chosen(page: Page, odds: np.ndarray) -> list[bool]:
    """Which nodes hold main text: the best choice in which a node that does has a parent that does."""
    nodes = page.nodes
    worth = [0.0, *odds.tolist()]
    for k in range(len(nodes) - 1, 0, -1):
        if worth[k] > 0:
            worth[nodes[k].parent] += worth[k]
    keep = [True] * len(nodes)
    for k in range(1, len(nodes)):
        keep[k] = keep[nodes[k].parent] and worth[k] > 0
    return keep


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    rows = [p.features() for p in pages]
    every = [r for own in rows for r in own]
    odds = np.concatenate([np.zeros(0), *(model.log_odds(matrix(every[k : k + 50_000])) for k in range(0, len(every), 50_000))])  # in blocks: a page may be large
    out, at = [], 0
    for p, own in zip(pages, rows, strict=True):
        keep = chosen(p, odds[at : at + len(own)])
        at += len(own)
        out.append("\n\n".join(t for k, t in p.blocks if keep[k]))
    return out


# ---- training pages ----

MAIN_CLASSES = ["content", "post", "entry-content", "article-body", "story", "main-text", "post-content", "blog-post", "page-content", "news-text"]
PLAIN_CLASSES = ["wrapper", "container", "row", "col-8", "inner", "box", "c1", "grid", "layout", "outer"]
BOILER: dict[str, tuple[list[str], list[str]]] = {  # tags and classes of what isn't main text
    "menu": (["nav", "div", "ul"], ["nav", "menu", "navbar", "main-menu", "breadcrumb", "pagination", "site-navigation"]),
    "header": (["header", "div"], ["header", "masthead", "site-header", "branding", "top-bar"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "legal", "colophon"]),
    "side": (["aside", "div"], ["sidebar", "widget", "side-rail", "secondary", "aside"]),
    "advert": (["div", "div", "section", "aside"], ["ad", "ads", "advert", "sponsored", "promo", "ad-box", "banner-ad", "advertisement"]),
    "notice": (["div", "div", "section"], ["cookie-notice", "notice", "consent", "alert", "popup", "newsletter", "subscribe", "gdpr-banner"]),
    "comment": (["section", "div", "ul", "ol"], ["comments", "comment-list", "reader-comments", "respond", "disqus", "replies"]),
    "share": (["div", "section", "ul"], ["share", "social", "related", "recommended", "more-links", "tags"]),
    "form": (["form"], ["search-form", "login", "contact", "form", ""]),
}


class PageMaker:
    """Generates pages; main text is drawn with the letter x, the rest with the letter z."""

    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, letter: str, n: int) -> str:
        r, out = self.r, []
        while n > 0:
            k = min(n, r.randint(1, 18))
            out.append(" ".join(letter * r.randint(1, 9) + "," * (r.random() < 0.08) for _ in range(k)) + r.choice([".", ".", ".", "", "!", "?"]))
            n -= k
        return " ".join(out)

    def attribute(self, names: list[str], chance: float = 0.9) -> str:
        r = self.r
        name = r.choice(names)
        if not name or r.random() > chance:
            return ""
        other = r.choice([*PLAIN_CLASSES, "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 8)))])
        return r.choice([f' class="{name}"', f' class="{other} {name}"', f' id="{name}"', f" class='{name}'"])

    def inset(self, letter: str) -> str:
        """Controls and graphics are never main text; what stands in for an object or a script is, in an article."""
        r = self.r
        return r.choice([
            f"<button>{self.words('z', r.randint(1, 3))}</button>", f"<select><option>{self.words('z', 1)}</option></select>", f"<svg><title>{self.words('z', 1)}</title><text>{self.words('z', 1)}</text></svg>",
            f"<video>{self.words('z', 5)}</video>", f"<template><p>{self.words('z', r.randint(1, 20))}</p></template>",
            f"<noscript>{self.words(letter, r.randint(1, 12))}</noscript>", f"<object>{self.words(letter, r.randint(1, 12))}</object>", f"<math><mi>{self.words(letter, 1)}</mi></math>",
        ])

    def boiler(self, kind: str) -> str:
        r = self.r
        tags, names = BOILER[kind]
        tag = r.choice(tags)
        sure = tag in ("nav", "header", "footer", "aside", "form")
        out = f"<{tag}{self.attribute(names, 0.4 if sure else 1.0)}>"
        if kind in ("menu", "share") or (kind in ("side", "footer", "header") and r.random() < 0.5):
            items = "".join(f'<li><a href="/z">{self.words("z", r.randint(1, 4))}</a></li>' for _ in range(r.randint(2, 9)))
            out += items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "comment":
            item = "li" if tag in ("ul", "ol") else r.choice(["div", "article", "p"])
            for _ in range(r.randint(1, 6)):
                out += f"<{item}{self.attribute(['comment', 'comment-body', 'reply', ''])}><p>{self.words('z', r.randint(3, 60))}</p></{item}>"
        elif kind == "form":
            out += f"<label>{self.words('z', 2)}</label><input><p>{self.words('z', r.randint(1, 12))}</p>"
        else:
            size = r.choice([3, 8, 20, 60])
            inner = self.words("z", r.randint(1, size))
            out += r.choice([inner, f"<p>{inner}</p>", f"<h3>{self.words('z', 3)}</h3><p>{inner}</p><p>{self.words('z', r.randint(1, size))}</p>"])
        return out + f"</{tag}>"

    def main_blocks(self) -> list[str]:
        r, out = self.r, []
        if r.random() < 0.75:
            out.append(f"<h1>{self.words('x', r.randint(1, 12))}</h1>")
        for _ in range(r.choice([1, 1, 2, 4, 8, 15])):
            k = r.random()
            size = r.choice([2, 10, 40, 120])
            if k < 0.72:
                link = f' <a href="/x">{self.words("x", 2)}</a> ' if r.random() < 0.3 else self.inset("x") if r.random() < 0.08 else ""
                out.append(f"<p>{self.words('x', r.randint(1, size))}{link}" + "</p>" * (r.random() < 0.85))
            elif k < 0.8:
                out.append(f"<h2>{self.words('x', r.randint(1, 7))}</h2>")
            elif k < 0.87:
                items = "".join(f"<li>{self.words('x', r.randint(1, 15))}</li>" for _ in range(r.randint(1, 6)))
                out.append(f"<ul>{items}</ul>")
            elif k < 0.92:
                out.append(f"<blockquote><p>{self.words('x', r.randint(3, 30))}</p></blockquote>")
            elif k < 0.96:
                out.append(f"<table><tr><td>{self.words('x', 2)}</td><td>{self.words('x', 3)}</td></tr></table>")
            else:
                out.append(f"<div>{self.words('x', r.randint(1, size))}</div>")
        return out

    def bare(self) -> str:
        """Links or a few words that stand in the body by themselves."""
        r = self.r
        links = [f'<a href="/z">{self.words("z", r.randint(1, 3))}</a>' for _ in range(r.randint(1, 7))]
        return r.choice([" ", " | ", ""]).join(links) if r.random() < 0.7 else self.words("z", r.randint(1, 6))

    def page(self) -> str:
        r = self.r
        if r.random() < 0.04:
            return self.words("x", r.choice([1, 10, 60, 300]))
        blocks = self.main_blocks()
        if r.random() < 0.1:
            blocks.insert(r.randint(0, len(blocks)), self.words("x", r.choice([8, 30, 90])))
        for kind in r.sample(["advert", "share", "notice", "menu", "side", "form"], r.choice([0, 0, 1, 2])):
            blocks.insert(r.randint(0, len(blocks)), self.boiler(kind))
        inside = "".join(blocks)
        style = r.random()
        if style < 0.45:
            inside = f"<article{self.attribute(MAIN_CLASSES, 0.3)}>{inside}</article>"
        elif style < 0.6:
            inside = f"<main{self.attribute(MAIN_CLASSES, 0.3)}>{inside}</main>"
        elif style < 0.9:
            inside = f"<{(t := r.choice(['div', 'div', 'section']))}{self.attribute(MAIN_CLASSES)}>{inside}</{t}>"
        if r.random() < 0.3:
            if r.random() < 0.4:
                inside += self.boiler(r.choice(["side", "comment", "share"]))
            inside = f'<div class="{r.choice(PLAIN_CLASSES)}">{inside}</div>'
        before = [self.bare() if r.random() < 0.1 else self.boiler(k) for k in ("notice", "header", "menu", "advert", "form", "side") if r.random() < 0.5]
        if r.random() < 0.1:
            before.append(self.inset("z"))
        after = [self.boiler(k) for k in ("share", "comment", "advert", "side", "notice", "form", "menu", "footer") if r.random() < 0.4]
        if r.random() < 0.1:
            after.insert(r.randint(0, len(after)), self.bare())
        return f"<html><body>{''.join(before)}{inside}{''.join(after)}</body></html>"


def training_pages(n_pages: int, seed: int) -> list[str]:
    maker = PageMaker(random.Random(seed))
    return [maker.page() for _ in range(n_pages)]


def labels_of(page: Page) -> list[int]:
    """1 for the nodes of a generated page that hold main text."""
    held = [0] * len(page.nodes)
    for k, text in page.blocks:
        if "x" in text:
            held[k] = 1
    for k in range(len(held) - 1, 0, -1):
        held[page.nodes[k].parent] |= held[k]
    return held[1:]


@lru_cache(maxsize=2)
def trained(n_pages: int = 1200, seed: int = 7) -> Boosted:
    pages = [Page(s) for s in training_pages(n_pages, seed)]
    x = matrix([r for p in pages for r in p.features()])
    y = np.array([v for p in pages for v in labels_of(p)], float)
    return Boosted.fit(x, y)


def extract_pages(pages: DataFrame, source: str = "html", text: str = "text", model: Boosted | None = None) -> DataFrame:
    """pages with their main text. Other columns stay as they are."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(main_texts(rows.tolist(), shared.value), dtype=object)

    return pages.withColumn(text, run(F.coalesce(F.col(source), F.lit(""))))
