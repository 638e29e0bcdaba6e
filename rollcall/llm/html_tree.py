"""Main text of web pages by a graphical model over the document tree.

Block elements and the runs of text inside them are the nodes of a tree; each is content
or boilerplate. A node's own features and its tie to its parent score the labels, messages
passed upward and then downward give every node's exact marginal, and the runs of text that
are more likely content than not are the main text. The weights are fitted by maximum
likelihood on labelled pages, which are made here from layouts of many kinds.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The training pages, and the steps of the fit.
TRAIN_PAGES = 500
TRAIN_STEPS = 150
SEED = 3

# A tag whose quotes are in order, a tag whose quotes are not, a comment, a declaration.
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# What such an element holds is no markup; it goes on to its end tag, or to the page's end.
_RAW = {"script", "style", "noscript", "iframe", "textarea", "title"}
# The text in such an element is not shown as the page's. It ends with whatever it lies in;
# blocks do not belong into those marked True, and end them.
_MUTED = {"svg": True, "select": True, "canvas": False, "template": False}
#: Elements deeper than this hang on the one at this depth, as browsers limit it too.
MAX_DEPTH = 200
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_GROUPS = (
    ("html", "body"),
    ("article", "main"),
    ("nav", "menu"),
    ("header",),
    ("footer",),
    ("aside",),
    ("form", "fieldset", "button", "label", "legend"),
    ("div", "section", "center"),
    ("ul", "ol", "li", "dl", "dt", "dd"),
    ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"),
    ("p", "blockquote", "pre"),
    ("h1", "h2", "h3", "h4", "h5", "h6"),
    ("figure", "figcaption", "details", "summary", "address", "dialog"),
)
_GROUP_OF = {tag: i for i, tags in enumerate(_GROUPS) for tag in tags}
_N_GROUPS = len(_GROUPS)
_PARAGRAPH, _HEADING = _GROUP_OF["p"], _GROUP_OF["h1"]
# Starting one of the values' keys ends an open element among the values.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody"),
}
_WALLS = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "html", "main", "aside", "nav"}
_END_OF = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in _RAW}
_HINTS = tuple(
    re.compile(p)
    for p in (
        r"article|post|entry|content|main|story|body|text|prose",
        r"nav|menu|crumb|toolbar|tabs|pagin|pager|skip",
        r"header|masthead|logo|topbar|site-?title|brand",
        r"foot|copyright|legal|colophon",
        r"side|aside|widget|rail|related|recommend|popular|trending|more",
        r"(?:^|[\s_-])ads?(?:[\s_-]|\d|$)|advert|sponsor|promo|banner",
        r"cookie|consent|notice|modal|popup|overlay|gdpr|newsletter|subscri|signup|alert|paywall",
        r"comment|repl(?:y|ies)|discuss|respond|disqus|reader",
        r"share|social|login|search|form|follow|bio|tags|meta|byline",
    )
)
_N_ELEMENT = 1 + _N_GROUPS + 1 + len(_HINTS) + 1 + 6
_N_RUN = 7 + _N_GROUPS + 1
N_FEATURES = _N_ELEMENT + _N_RUN


class _Open:
    """The open elements, and where in their order those of each tag stand."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.nodes: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.blocks: list[int] = []
        self.muted = 0

    def push(self, tag: str, node: int) -> None:
        here = len(self.tags)
        self.tags.append(tag)
        self.nodes.append(node)
        self.at.setdefault(tag, []).append(here)
        if tag in _WALLS:
            self.walls.append(here)
        if tag in _GROUP_OF:
            self.blocks.append(here)
        self.muted += tag in _MUTED

    def shut(self, depth: int) -> None:
        """Close the element at ``depth`` and all inside it."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.nodes.pop()
            self.at[tag].pop()
            if tag in _WALLS:
                self.walls.pop()
            if tag in _GROUP_OF:
                self.blocks.pop()
            self.muted -= tag in _MUTED

    def last(self, *tags: str) -> int:
        """The innermost element with one of these tags, or 0 for the page."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def linked(self) -> bool:
        return bool(self.at.get("a"))


class Page:
    """The tree of one page: parents come before their children."""

    __slots__ = ("parent", "depth", "features", "measures", "runs")

    def __init__(self, source: str) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        # Of an element, the features that hold; of a run, its measures and their place.
        self.features: list[list[int]] = []
        self.measures: list[tuple[float, ...]] = []
        self.runs: list[tuple[int, str]] = []
        self._read(source)

    def _hang(self, parent: int, known: list[int]) -> int:
        if parent >= 0 and self.depth[parent] >= MAX_DEPTH:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.features.append(known)
        return len(self.parent) - 1

    def _element(self, parent: int, tag: str, attributes: str) -> int:
        known = [0, 1 + _GROUP_OF.get(tag, _N_GROUPS)]
        if attributes:
            names, hidden = [], False
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("class", "id", "role", "aria-label"):
                    names.append(value)
                hidden |= name == "hidden" or (name == "aria-hidden" and value == "true")
                hidden |= name == "style" and "display:none" in value.replace(" ", "")
            said = " ".join(names)
            if said:
                known += [2 + _N_GROUPS + i for i, hint in enumerate(_HINTS) if hint.search(said)]
            if hidden:
                known.append(2 + _N_GROUPS + len(_HINTS))
        return self._hang(parent, known)

    def _read(self, source: str) -> None:
        groups = [_GROUP_OF["html"]]
        root = self._element(-1, "html", "")
        open_ = _Open()  # inline elements share their block's node
        open_.push("html", root)
        parts: list[str] = []
        linked = 0
        at, end = 0, len(source)

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            if text:
                node = open_.nodes[-1]
                n = len(text)
                words = text.count(" ") + 1
                self.measures.append((1.0, math.log1p(n) / 5, min(1.0, linked / n), float(words < 5), float(text[-1] in ".!?:;\"”»…"),
                                      float("©" in text or "(c)" in text.lower()), min(1.0, 10 * text.count(",") / n)))
                self.runs.append((self._hang(node, [_N_ELEMENT + 7 + groups[node]]), text))
                groups.append(-1)
            parts.clear()
            linked = 0

        def say(text: str) -> None:
            nonlocal linked
            if open_.muted:
                return
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if open_.linked():
                linked += len(text)

        while at < end:
            mark = _MARK.search(source, at)
            if mark is None:
                say(source[at:])
                break
            if mark.start() > at:
                say(source[at : mark.start()])
            at = mark.end()
            closing, tag, attributes = mark.group(1), mark.group(2), mark.group(3)
            if tag is None:
                closing, tag, attributes = mark.group(4), mark.group(5), mark.group(6)
                if tag is None:
                    continue
            tag = tag.lower()
            block = tag in _GROUP_OF
            if closing:
                depth = open_.last(tag)
                if block or tag in _MUTED:
                    flush()
                elif depth < open_.blocks[-1]:
                    depth = 0  # an inline end tag closes nothing outside its block
                if depth > 0:
                    open_.shut(depth)
                continue
            if tag in _RAW:
                if not attributes.endswith("/"):
                    stop = _END_OF[tag].search(source, at)
                    at = stop.end() if stop else end
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag in _MUTED:
                if not attributes.endswith("/"):
                    open_.push(tag, open_.nodes[-1])
                continue
            if not block:
                open_.push(tag, open_.nodes[-1])
                continue
            flush()
            if tag in ("html", "body") and len(open_.tags) == 1:
                continue
            if open_.muted and (depth := open_.last(*(t for t, ends in _MUTED.items() if ends))) > open_.last("template", "canvas", "foreignobject"):
                open_.shut(depth)
            shut = _ENDS.get(tag, ())
            while (depth := open_.last("p", *shut)) > (open_.walls[-1] if open_.walls else 0):
                name = open_.tags[depth]
                open_.shut(depth)
                # Of a table's rows and cells, all that the new one cannot lie in end.
                if name != "p" and tag not in ("tr", "tbody", "tfoot"):
                    break
                if name == "p" and not shut:
                    break
            open_.push(tag, self._element(open_.nodes[-1], tag, attributes))
            groups.append(_GROUP_OF[tag])
        flush()


def matrix(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents, depths and kinds (1 for text) of all nodes of some pages."""
    sizes = [len(p.parent) for p in pages]
    total = sum(sizes)
    first = np.cumsum([0, *sizes])
    x = np.zeros((total, N_FEATURES))
    parent = np.empty(total, np.int64)
    depth = np.empty(total, np.int64)
    kind = np.zeros(total, np.int8)
    for p, at in zip(pages, first):
        n = len(p.parent)
        up = np.array(p.parent, np.int64)
        parent[at : at + n] = np.where(up < 0, -1, up + at)
        depth[at : at + n] = p.depth
        is_run = np.zeros(n, bool)
        is_run[[i for i, _ in p.runs]] = True
        kind[at : at + n] = is_run
        held = [len(f) for f in p.features]
        x[np.repeat(np.arange(at, at + n), held), [i for f in p.features for i in f]] = 1.0
        if p.runs:
            x[at + np.flatnonzero(is_run), _N_ELEMENT : _N_ELEMENT + 7] = p.measures
    # What lies below an element: characters, the share of them in links and in
    # paragraphs, the number of runs, and the shares of the page's characters and of those
    # outside links.
    run = kind == 1
    chars = np.where(run, np.expm1(5 * x[:, _N_ELEMENT + 1]), 0.0)
    below = np.stack(
        [chars, chars * x[:, _N_ELEMENT + 2], chars * x[:, _N_ELEMENT + 7 + _PARAGRAPH], run.astype(float)], 1
    )
    for d in range(int(depth.max(initial=0)), 0, -1):
        here = np.flatnonzero(depth == d)
        np.add.at(below, parent[here], below[here])
    e = ~run
    size = np.maximum(below[e, 0], 1.0)
    x[e, _N_ELEMENT - 6] = np.log1p(below[e, 0]) / 8
    x[e, _N_ELEMENT - 5] = below[e, 1] / size
    x[e, _N_ELEMENT - 4] = below[e, 2] / size
    x[e, _N_ELEMENT - 3] = np.log1p(below[e, 3]) / 4
    whole = np.maximum(below[np.repeat(first[:-1], sizes)[e]], 1.0)
    x[e, _N_ELEMENT - 2] = below[e, 0] / whole[:, 0]
    x[e, _N_ELEMENT - 1] = (below[e, 0] - below[e, 1]) / np.maximum(whole[:, 0] - whole[:, 1], 1.0)
    return x, parent, depth, kind


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []


def beliefs(
    unary: np.ndarray, tie: np.ndarray, parent: np.ndarray, kind: np.ndarray, levels: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every node, and of every node together with its parent.

    ``unary`` is a score per node and label, ``tie`` one per kind of node, label of the
    parent and label of the node.
    """
    up = unary.copy()  # own score and messages from below
    message = np.zeros_like(unary)  # to the parent
    for here in reversed(levels[1:]):
        message[here] = np.logaddexp.reduce(up[here][:, None, :] + tie[kind[here]], axis=2)
        np.add.at(up, parent[here], message[here])
    full = up.copy()
    pair = np.zeros((len(unary), 2, 2))
    for here in levels[1:]:
        rest = full[parent[here]] - message[here]  # what the parent knows from elsewhere
        joint = rest[:, :, None] + tie[kind[here]] + up[here][:, None, :]
        full[here] = np.logaddexp.reduce(joint, axis=1)
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pair[here] = joint / joint.sum((1, 2), keepdims=True)
    node = np.exp(full - full.max(1, keepdims=True))
    return node / node.sum(1, keepdims=True), pair


def fitted(pages: list[Page], labels: list[np.ndarray]) -> dict:
    """Weights and ties of highest likelihood, with a small penalty, by Adam."""
    x, parent, depth, kind = matrix(pages)
    y = np.concatenate(labels)
    levels = _levels(depth)
    inner = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[inner], y[parent[inner]], y[inner]), 1.0)
    weight, tie = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    theta = np.zeros(N_FEATURES + 8)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, TRAIN_STEPS + 1):
        weight, tie = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2)
        unary = np.stack([np.zeros(len(x)), x @ weight], 1)
        node, pair = beliefs(unary, tie, parent, kind, levels)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, kind[inner], pair[inner])
        grad = np.concatenate([x.T @ (y - node[:, 1]), (seen - expected).ravel()]) / len(x) - 1e-4 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return {"weight": theta[:N_FEATURES], "tie": theta[N_FEATURES:].reshape(2, 2, 2)}


def main_texts(model: dict, sources: list[str]) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, parent, depth, kind = matrix(pages)
    unary = np.stack([np.zeros(len(x)), x @ model["weight"]], 1)
    node, _ = beliefs(unary, model["tie"], parent, kind, _levels(depth))
    out, at = [], 0
    for p in pages:
        out.append("\n".join(text for i, text in p.runs if node[at + i, 1] > 0.5))
        at += len(p.parent)
    return out


# --- Labelled pages -------------------------------------------------------------------


class _Maker:
    """Pages of many layouts. Runs of content carry a mark, which gives their labels."""

    MARK = "\ue000"  # not in any alphabet

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int, content: bool) -> str:
        r = self.r
        out, new = [], True
        for _ in range(r.randint(low, high)):
            word = "".join(r.choice("aeiounrstlmd") for _ in range(r.randint(2, 9)))
            out.append(word.capitalize() if new else word)
            new = r.random() < 0.1
            if new:
                out[-1] += r.choice(".,.!?")
        return (self.MARK if content else "") + " ".join(out) + (r.choice(["", ".", "."]) if high > 8 else "")

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(low, high, False)}</a>'

    def named(self, *names: str) -> str:
        kind = self.r.random()
        name = self.r.choice(names)
        return "" if kind < 0.25 else f' class="{name}"' if kind < 0.75 else f' id="{name}"'

    def items(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(low, high))) + "</ul>"

    def nav(self) -> str:
        r, body = self.r, self.items(3, 9)
        if r.random() < 0.3:
            body = " | ".join(self.link() for _ in range(r.randint(3, 8)))
        if r.random() < 0.6:
            return f"<nav{self.named('nav', 'menu', 'main-nav', 'breadcrumb')}>{body}</nav>"
        return f'<div class="{r.choice(["nav", "menu", "navbar", "top-menu", "breadcrumbs"])}">{body}</div>'

    def header(self) -> str:
        r = self.r
        body = f"<{(t := r.choice(['h1', 'h2', 'div', 'p']))}{self.named('logo', 'site-title', 'brand')}>{self.link(1, 4) if r.random() < 0.5 else self.words(1, 6, False)}</{t}>"
        if r.random() < 0.5:
            body += f"<p>{self.words(3, 12, False)}</p>"
        if r.random() < 0.4:
            body += self.nav()
        if r.random() < 0.6:
            return f"<header{self.named('header', 'site-header', 'masthead')}>{body}</header>"
        return f'<div class="{r.choice(["header", "masthead", "topbar", "site-header", "banner"])}">{body}</div>'

    def footer(self) -> str:
        r = self.r
        body = r.choice(["&copy; ", "(c) ", ""]) + self.words(2, 25, False)
        if r.random() < 0.5:
            body = f"<p>{body}</p>"
        if r.random() < 0.5:
            body += self.items(2, 6)
        if r.random() < 0.7:
            return f"<footer{self.named('footer', 'site-footer')}>{body}</footer>"
        return f'<div {r.choice(["class", "id"])}="{r.choice(["footer", "copyright", "legal", "colophon"])}">{body}</div>'

    def aside(self) -> str:
        r = self.r
        body = f"<h3>{self.words(1, 4, False)}</h3>" + r.choice(
            [self.items(3, 8), f"<p>{self.words(8, 60, False)}</p>", f"<p>{self.words(5, 30, False)} {self.link()}</p>"]
        )
        if r.random() < 0.6:
            return f"<aside{self.named('sidebar', 'aside', 'related', 'widget')}>{body}</aside>"
        name = r.choice(["sidebar", "related", "widget", "right-rail", "popular", "recommended", "side", "more-stories"])
        return f'<{(t := r.choice(["div", "section"]))} {r.choice(["class", "id"])}="{name}">{body}</{t}>'

    def ad(self) -> str:
        r = self.r
        name = r.choice(["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad"])
        text = self.words(3, 50, False)
        return f'<div class="{name}">{r.choice([text, f"<p>{text}</p>", f"<p>{text}</p>{self.link()}"])}</div>'

    def notice(self) -> str:
        r = self.r
        name = r.choice(["cookie", "cookie-notice", "consent", "gdpr-banner", "notice", "newsletter", "alert", "modal", "paywall", "popup"])
        text = f"<p>{self.words(6, 50, False)}</p>" if r.random() < 0.7 else self.words(6, 40, False)
        return f'<{(t := r.choice(["div", "div", "section", "aside"]))} {r.choice(["class", "id"])}="{name}">{text}{r.choice(["", "<button>Ok</button>", self.link()])}</{t}>'

    def form(self) -> str:
        r = self.r
        body = "".join(f"<label>{self.words(1, 3, False)} <input type=text></label>" for _ in range(r.randint(1, 4)))
        body = r.choice(["", f"<h3>{self.words(1, 5, False)}</h3>", f"<p>{self.words(4, 25, False)}</p>"]) + body
        return f"<form{self.named('search', 'login', 'signup', 'contact-form')}>{body}<button>{self.words(1, 2, False)}</button></form>"

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice(
            [
                f'<div class="comment"><b>{self.words(1, 2, False)}</b><p>{self.words(5, 60, False)}</p></div>',
                f'<li class="comment"><p>{self.words(5, 60, False)}</p></li>',
                f'<article class="comment"><p>{self.words(5, 60, False)}</p></article>',
                f"<p>{self.words(5, 60, False)}</p>",
            ]
        )
        body = f"<h{(h := r.choice('23'))}>{self.words(1, 3, False)}</h{h}>" + "".join(one() for _ in range(r.randint(1, 6)))
        name = r.choice(["comments", "comment-list", "reader-comments", "responses", "discussion", "replies"])
        return f'<{(t := r.choice(["div", "section", "ol"]))} {r.choice(["class", "id"])}="{name}">{body}</{t}>'

    def paragraph(self) -> str:
        r = self.r
        low, high = r.choice([(2, 8), (10, 60), (30, 150), (60, 250)])
        text = self.words(low, high, True)
        if r.random() < 0.2:
            text += f" {self.link(1, 5)} {self.words(2, 12, False)}"
        if r.random() < 0.15:
            return f"<p><b>{text}<br>"  # left open
        if r.random() < 0.1:
            text = f"<{(t := r.choice(['b', 'em', 'span']))}>{text}</{t}>"
        return f"<p>{text}{r.choice(['</p>', '</p>', '</p>', ''])}"

    def content(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(f"<h1{self.named('title', 'headline')}>{self.words(2, 22, True)}</h1>")
            if r.random() < 0.15:
                out[-1] = f"<header>{out[-1]}</header>"
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.75:
                out.append(self.paragraph())
            elif kind < 0.82:
                out.append(f"<h{(h := r.choice('234'))}>{self.words(1, 8, True)}</h{h}>")
            elif kind < 0.88:
                # Sources and the like: links, but of the article.
                said = lambda: f'<a href="/{r.randint(1, 999)}">{self.words(1, 8, True)}</a>'
                links = "".join(f"<li>{said()}</li>" for _ in range(r.randint(2, 6)))
                out.append(r.choice(["", f"<h3>{self.words(1, 3, True)}</h3>"]) + f"<ul>{links}</ul>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(f"<li>{self.words(1, 25, True)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote><p>{self.words(5, 50, True)}</p></blockquote>")
            elif kind < 0.96:
                rows = "".join(f"<tr><td>{self.words(1, 5, True)}</td><td>{self.words(1, 5, True)}</td></tr>" for _ in range(r.randint(2, 5)))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.97:
                formula = f"<mi>{self.words(1, 1, True)}</mi><mo>=</mo><mi>{self.words(1, 1, False)}</mi>"
                out.append(f"<p>{self.words(3, 20, True)} <math>{formula}</math> {self.words(2, 9, True)}</p>")
            elif kind < 0.975:
                out.append(f"<object data=f><p>{self.words(3, 20, True)}</p></object>")
            elif kind < 0.985:
                out.append(f"<pre>{self.words(3, 30, True)}</pre>")
            else:
                out.append(r.choice([self.ad, self.aside, self.notice])())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = self.content()
        if r.random() < 0.25:
            body += r.choice([self.comments, self.aside, self.form, self.ad])()
        wrap = r.random()
        if wrap < 0.5:
            body = f"<article{self.named('post', 'article', 'story')}>{body}</article>"
        elif wrap < 0.65:
            body = f"<main{self.named('main', 'content')}>{body}</main>"
        elif wrap < 0.9:
            body = f'<div {r.choice(["class", "id"])}="{r.choice(["content", "post", "entry", "article-body", "main", "story", "text"])}">{body}</div>'
        else:
            body = f"<div>{body}</div>"
        before = [f() for f in (self.header, self.nav, self.ad, self.notice, self.form, self.aside) if r.random() < 0.4]
        after = [f() for f in (self.comments, self.aside, self.ad, self.form, self.notice, self.nav) if r.random() < 0.35]
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.footer())
        inner = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            inner = f"<div{self.named('wrapper', 'page', 'container')}>{inner}</div>"
        ends = "</body></html>" if r.random() < 0.9 else ""
        if r.random() < 0.25:
            inner = self.unnamed(inner)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8, False)}</title><script>var a='</p>';</script></head><body>{inner}{ends}"

    def unnamed(self, inner: str) -> str:
        """The same layout in elements and names that say nothing."""
        r = self.r
        inner = re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section)\b", r"<\1div", inner)
        if r.random() < 0.4:
            inner = re.sub(r"<(/?)(?:p|h1|h2|h3|h4)\b", r"<\1div", inner)
        known: dict[str, str] = {}
        name = lambda m: known.setdefault(m.group(0), f' class="{r.choice("bcdfgkq")}{r.randint(1, 9999)}"')
        drop = r.random() < 0.4
        return re.sub(r' (?:class|id)="[^"]*"', (lambda m: "") if drop else name, inner)


def labelled(n: int, seed: int = SEED) -> tuple[list[Page], list[np.ndarray]]:
    """Pages and the labels of their nodes. An element is content if most of its text is."""
    maker = _Maker(seed)
    pages, labels = [], []
    for _ in range(n):
        page = Page(maker.page())
        chars = np.zeros((len(page.parent), 2))
        y = np.zeros(len(page.parent), np.int64)
        for i, text in page.runs:
            y[i] = _Maker.MARK in text
            chars[i, y[i]] = len(text)
        for i in range(len(page.parent) - 1, 0, -1):
            chars[page.parent[i]] += chars[i]
        run = np.zeros(len(y), bool)
        run[[i for i, _ in page.runs]] = True
        y = np.where(run, y, chars[:, 1] > chars[:, 0])
        pages.append(page)
        labels.append(y.astype(np.int64))
    return pages, labels


@cache
def trained() -> dict:
    """The model, fitted once in a process: its pages depend on nothing that is given."""
    return fitted(*labelled(TRAIN_PAGES))


def extracted(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """The main text of every page.

    ``pages`` has ``page_id``, ``url`` and ``html``; other columns are left aside. Null
    html is empty. Character references are decoded, white space inside a block becomes
    one space, a line break among it, and blocks are joined in page order by a line feed.
    Scripts, styles and the like are left out before; broken markup is read on as browsers
    do: an unclosed paragraph ends at the next block, an unclosed script at the page's end,
    and an unclosed drawing or list of choices where what it lies in ends or a block begins.
    Reading takes time in proportion to a page's length, whatever its tags.
    A page without content, or without html, has empty text. Repeated rows are read each;
    an empty table gives no rows.

    Returns ``page_id, url, text, n_chars``.
    """
    model = model or trained()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = main_texts(model, [h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kind}, url string, text string, n_chars long"
    )
