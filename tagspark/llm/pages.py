"""Main text of web pages by a tree-structured graphical model.

Each block element of a page, and each run of text in one, is a variable: content or not. A variable has a potential from its
own features (element, telling class names, share of link text, length, punctuation), and each has one with its parent.
On a tree, sum-product gives exact marginals in one pass of messages up and one down; a run of text is kept where
its marginal says content. Weights are those that make labelled pages most likely: the gradient is the labels less the marginals.

Pages go through one row at a time in Arrow batches; the messages of a batch are passed level by level for all its pages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled_pages
from .rows import pick, slices

#: Labelled pages that the weights are trained on, and steps of the training.
PAGES, STEPS = 400, 120
#: HTML's elements by what they do to the tree.
BLOCKS = set(
    "html head body div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset legend label address details summary center dialog menu search hgroup button select optgroup option noscript".split()
)
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = {"head", "button", "select", "optgroup", "option"}
#: An opening tag ends these open ones, up to the elements of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
CELLS = {"td", "th", "table", "html"}
GROUPS = [{"article"}, {"main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "legend", "search", "dialog"}, {"p", "pre", "blockquote"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, {"figure", "figcaption"}, {"div", "section"}]
#: Words of classes, ids and roles, by what they tell.
TELLING = [
    "article content post entry story main text body".split(),
    "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager tabs toc".split(),
    "header masthead topbar banner logo".split(),
    "footer copyright bottom legal contentinfo".split(),
    "sidebar side aside widget rail complementary related recommended more trending popular".split(),
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner".split(),
    "comment comments reply replies discussion responses respond disqus".split(),
    "cookie cookies consent gdpr notice alert popup modal overlay disclaimer warning dialog".split(),
    "form login signup register search subscribe newsletter contact".split(),
    "share sharing social follow tags tag meta byline author".split(),
]
_KIND = {w: {i for i, ws in enumerate(TELLING) if w in ws} for ws in TELLING for w in ws}
_GROUP = {tag: i for i, tags in enumerate(GROUPS) for tag in tags}
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+"""
_TOKEN = re.compile(rf"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden|data-y)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Features: groups and telling words of an element, hidden, own; then those of a run of text, with its element's group.
OF_ELEMENT = len(GROUPS) + len(TELLING) + 2
OF_TEXT = 14
SIZE = OF_ELEMENT + OF_TEXT + len(GROUPS) + 1
EDGES = 3  # to an element with a telling name or group, to another one, to a text


@dataclass
class Tree:
    """A page's variables in page order, parents first."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    features: list[list[int | tuple[int, float]]] = field(default_factory=list)
    edge: list[int] = field(default_factory=list)
    never: list[bool] = field(default_factory=list)
    mute: list[bool] = field(default_factory=list)  # hidden: decided by what it stands in, which it says nothing of
    text: list[str | None] = field(default_factory=list)
    label: list[int] = field(default_factory=list)

    def add(self, parent, features, edge, never, text=None, label=0, mute=False) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.features.append(features)
        self.edge.append(edge)
        self.never.append(never)
        self.mute.append(never or mute)
        self.text.append(text)
        self.label.append(label)
        return len(self.parent) - 1


def element_features(tag: str, attributes: str) -> tuple[list, bool, bool, int | None]:
    """(features, does it tell something, hidden, label) of an element."""
    group, told, hidden, label = _GROUP.get(tag), set(), False, None
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "data-y":
                label = int(value)
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            else:
                for w in _NAME.findall(value):
                    told |= _KIND.get(w.lower(), set())
    found = [] if group is None else [group]
    found += [len(GROUPS) + k for k in told]
    if hidden:
        found.append(OF_ELEMENT - 2)
    found.append(OF_ELEMENT - 1)
    return found, bool(told) or group is not None and group < 7, hidden, label


def text_features(text: str, linked: int, tag: str) -> list:
    """Of a run of text: length, link share, sentences, marks of a notice."""
    n, base = len(text), OF_ELEMENT
    count = text.count(" ") + 1
    share = min(1.0, linked / n)
    bucket = min(6, count.bit_length() - 1)
    found: list = [base + bucket, (base + 7, share), base + 13]
    if share > 0.8:
        found.append(base + 8)
    if text[-1] in ".!?\"”»…":
        found.append(base + 9)
    found.append((base + 10, min(1.0, (text.count(",") + text.count(".")) / (count / 4 + 1))))
    if "©" in text:
        found.append(base + 11)
    if count <= 3:
        found.append(base + 12)
    found.append(base + OF_TEXT + _GROUP.get(tag, len(GROUPS)))
    return found


def parse(html: str) -> Tree:
    """The tree of a page's blocks and runs of text. Tags that are never closed, or were never open, do no harm."""
    tree = Tree()
    stack = [(tree.add(-1, [OF_ELEMENT - 1], 1, False), "html", False, 0)]  # node, tag, inside what never is content, label
    at, run, linked, in_link = 0, [], 0, 0
    size = len(html)

    def flush():
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                node, tag, never, label = stack[-1]
                tree.add(node, text_features(text, linked, tag), 2, never, text, label)
            run, linked = [], 0

    def take(text):
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            run.append(text)
            if in_link:
                linked += len(text)

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            take(html[at:])
            break
        take(html[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag in RAW and not closing:
            if not attributes.endswith("/") or tag in ("script", "style", "title", "textarea"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = size if end is None else end.start()
        elif tag in VOID:
            run.append(" " if tag == "br" else "")
            if tag == "hr":
                flush()
        elif tag in BLOCKS:
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] == tag:
                        del stack[i:]
                        break
                    if stack[i][1] in CELLS and tag not in CELLS and tag not in ("tr", "tbody", "thead", "tfoot", "body"):
                        break
                in_link = 0
                continue
            if tag == "html":
                continue
            over, until = ENDS.get(tag, (set(), set()))
            if tag not in ("button", "label", "option", "select"):
                over = over | {"p"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][1] in over:
                    del stack[i:]
                    if tag not in ("tr", "tbody"):
                        break
                elif stack[i][1] in until or stack[i][1] in BLOCKS and not until:
                    break
            node, _, never, label = stack[-1]
            features, tells, hidden, own = element_features(tag, attributes)
            never = never or tag in NEVER
            label = label if own is None else own
            stack.append((tree.add(node, features, 0 if tells else 1, never, None, label, hidden), tag, never, label))
    flush()
    return tree


class Forest:
    """Trees side by side as arrays, so that messages pass for all of them at once."""

    def __init__(self, trees: list[Tree]):
        offset, parent = 0, []
        for t in trees:
            parent += [p + offset if p >= 0 else -1 for p in t.parent]
            offset += len(t.parent)
        self.parent = np.array(parent, dtype=np.int64)
        depth = np.concatenate([np.array(t.depth) for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        self.edge = np.concatenate([np.array(t.edge) for t in trees])
        self.never = np.concatenate([np.array(t.never, dtype=bool) for t in trees])
        self.mute = np.concatenate([np.array(t.mute, dtype=bool) for t in trees])
        rows, columns, values, i = [], [], [], 0
        for t in trees:
            for found in t.features:
                for f in found:
                    k, v = f if isinstance(f, tuple) else (f, 1.0)
                    rows.append(i)
                    columns.append(k)
                    values.append(v)
                i += 1
        self.rows, self.columns, self.values = np.array(rows), np.array(columns), np.array(values)

    def unary(self, w: np.ndarray) -> np.ndarray:
        score = np.bincount(self.rows, weights=w[self.columns] * self.values, minlength=len(self.parent))
        return np.stack([np.zeros_like(score), score], axis=1)

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each variable, and the joint of parent and variable, by messages up and down the tree."""
        belief = self.unary(w)
        up = np.zeros_like(belief)
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(pair[self.edge[level]] + belief[level][:, None, :], axis=2)
            up[level[self.mute[level]]] = 0
            np.add.at(belief, self.parent[level], up[level])
        full = belief.copy()
        joint = np.zeros((len(belief), 2, 2))
        for level in self.levels[1:]:
            rest = full[self.parent[level]] - up[level]
            both = rest[:, :, None] + pair[self.edge[level]] + belief[level][:, None, :]
            both -= np.logaddexp.reduce(both.reshape(len(level), 4), axis=1)[:, None, None]
            joint[level] = np.exp(both)
            full[level] = belief[level] + np.logaddexp.reduce(rest[:, :, None] + pair[self.edge[level]], axis=1)
        chance = 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700)))
        return np.where(self.never, 0.0, chance), joint


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def content(self, trees: list[Tree]) -> list[str]:
        """The kept runs of text of each page, joined by line ends."""
        if not trees:
            return []
        chance, _ = Forest(trees).marginals(self.weights, self.pair)
        out, i = [], 0
        for t in trees:
            out.append("\n".join(s for k, s in enumerate(t.text) if s is not None and chance[i + k] > 0.5))
            i += len(t.parent)
        return out


def train(trees: list[Tree], steps: int = STEPS, rate: float = 0.15, decay: float = 0.3) -> Model:
    """Weights that make the labels likely: steps up the gradient, each scaled by the weight's own past ones."""
    forest = Forest(trees)
    y = np.concatenate([np.array(t.label, dtype=float) for t in trees])
    y[forest.never] = 0
    inner = (forest.parent >= 0) & ~forest.mute
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edge[inner], y[forest.parent[inner]].astype(int), y[inner].astype(int)), 1)
    w, pair = np.zeros(SIZE), np.zeros((EDGES, 2, 2))
    mw, vw, mp, vp = np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)
    for step in range(1, steps + 1):
        chance, joint = forest.marginals(w, pair)
        rest = np.where(forest.never, 0, y - chance)
        gw = np.bincount(forest.columns, weights=rest[forest.rows] * forest.values, minlength=SIZE) - decay * w
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.edge[inner], joint[inner])
        gp = seen - expected - decay * pair
        for value, g, m, v in ((w, gw, mw, vw), (pair, gp, mp, vp)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(w, pair)


@lru_cache(maxsize=1)
def trained(count: int = PAGES) -> Model:
    return train([parse(html) for html in labelled_pages.pages(count)])


def main_text(pages: DataFrame, model: Model | None = None, html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the content blocks joined by line ends.

    White space inside a block is one blank. A null or empty html, or one without content, gives an empty text.
    """
    model = model or trained()
    source = pick(pages, "page_id", "url", html_column).toDF("page_id", "url", "html")

    def run(batches):
        for batch in slices(batches, "html", 2 << 20):
            texts = model.content([parse(h or "") for h in batch.column("html").to_pylist()])
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
