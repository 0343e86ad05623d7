"""Main text of web pages by gradient-boosted trees over the nodes of the document tree.

Every element gets features: its tag, its attributes' tokens and those of its ancestors, depth, density of text
and links in its subtree, and how it stands among its siblings. Boosted regression trees turn them into the log-odds
that the element belongs to the article. Decoding is hierarchical: of all labellings in which nothing inside a
dropped element is kept, the one with the largest sum of log-odds is chosen by one pass up and one pass down the tree,
so an ancestor and its descendants never contradict each other. Pages carry no labels, so the trees are fitted on
pages composed from layouts (sections of many kinds in many mark-ups and orders) whose truth is known; the fit takes a
few seconds, is deterministic and of bounded size.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by
one space in page order. Nothing else is dropped or capped.

Defined results: null or empty html, or a page without text, gives the empty text; text outside any element
counts as a block of the body; unclosed elements end where HTML says; form controls (button, select, textarea) go with the forms,
mathematics, drawings' texts and fallback texts of objects stay; malformed markup costs no more time than other text; repeated rows are done one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title".split())  # no markup inside
SILENT = RAW | frozenset("head select button option".split())
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul summary".split())
ENDS = {  # an opening tag ends these open ones, up to the named containers
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
TAGS = ("p", "h1", "h2", "h3", "li", "ul", "a", "nav", "aside", "footer", "header", "form", "article", "main", "section", "div", "span", "table", "td", "blockquote", "figure", "figcaption", "pre", "dialog", "label", "body")
# Tokens of class, id, role and aria-label by what they announce.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pager pagination sitemap skip topbar toolbar",
    "advert": "ad ads adv advert advertisement advertorial banner sponsor sponsored promo promotion promoted affiliate adsbygoogle dfp outbrain taboola",
    "footer": "footer foot bottom colophon copyright legal imprint",
    "header": "header head masthead logo branding site-header top hero-nav",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more-stories trending popular teaser teasers also secondary complementary",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback reviews thread",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup paywall warning toast dialog announcement",
    "share": "share sharing social follow tweet facebook twitter whatsapp like buttons",
    "form": "form search searchbox login input contact field",
    "content": "content article post entry story text body main maincontent article-body post-content entry-content articlebody prose markdown",
    "byline": "byline author meta date time tags tag category timestamp published",
    "hidden": "hidden hide sr-only visually-hidden invisible noprint",
}
HINT_OF = {t: k for k, ts in HINTS.items() for t in ts.split()}
KINDS = tuple(HINTS)
TAG_HINT = {"nav": "menu", "aside": "side", "footer": "footer", "header": "header", "form": "form", "dialog": "notice", "article": "content", "main": "content"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")  # of a tag; quoted values may hold the bracket
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[\s_]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "children", "items", "hints", "inline", "linked", "own", "hidden")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.children, self.items = tag, parent, [], []
        self.own = 0
        hints: set[str] = {TAG_HINT[tag]} if tag in TAG_HINT else set()
        self.hidden = False
        if attributes and not attributes.isspace():
            for m in ATTRIBUTE.finditer(attributes):
                name = m[1].lower()
                value = m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role", "aria-label", "itemprop", "data-role", "data-component"):
                    for word in PARTS.split(value):
                        word = word.lower()
                        for t in (word, *word.split("-")):
                            if t in HINT_OF:
                                hints.add(HINT_OF[t])
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden = True
        if self.hidden:
            hints.add("hidden")
        self.hints = frozenset(hints)


class _Open:
    """The open elements, and at which depths those of each tag are, so that no end or beginning of an element walks up the tree."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCK:
            self.blocks.append(depth)

    def close(self, depth: int) -> None:
        """Ends the elements from this depth on."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_below(self, depth: int, *tags: str) -> int:
        """The outermost of these tags deeper than depth, 0 if there is none."""
        found = [x[k] for x in (self.at.get(t, ()) for t in tags) if (k := bisect_right(x, depth)) < len(x)]
        return min(found, default=0)


ENDED, COMMENT_END = re.compile("-?>"), re.compile("--!?>")


def _tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(begin, end, name, attributes, is an end tag) of each tag or other markup (without a name), each character looked at once or
    so. If a tag's quotes never close, tags end at the first bracket from there on; a last tag without one is text."""
    at, quotes = page.find("<"), True
    while at >= 0:
        if page.startswith("<!--", at):
            if short := ENDED.match(page, at + 4):  # <!--> and <!---> end at once
                end = short.end()
            else:
                over = COMMENT_END.search(page, at + 4)
                end = over.end() if over else len(page)
            yield at, end, "", "", False
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", "", False
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            yield at, end, "", "", False
        else:
            closing = page.startswith("/", at + 1)
            name = NAME.match(page, at + 1 + closing)
            end = at + 1
            if name:
                rest = REST.match(page, name.end()) if quotes else None
                if rest is None:
                    quotes = False
                    bracket = page.find(">", name.end())
                    if bracket < 0:
                        return
                    end = bracket + 1
                else:
                    end = rest.end()
                yield at, end, name[0].lower(), page[name.end() : end - 1], closing
        at = page.find("<", end)


def parse(page: str) -> Node:
    """The tree of a page, in time proportional to its length. Texts are items of their elements, in order with the children."""
    root = Node("body", None)
    tree, at = _Open(root), 0

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            tree.nodes[-1].items.append(entities.unescape(raw) if "&" in raw else raw)
        elif raw:
            tree.nodes[-1].items.append(" ")

    def begin(name: str, attributes: str) -> Node:
        node = Node(name, tree.nodes[-1], attributes)
        node.parent.children.append(node)
        node.parent.items.append(node)
        tree.push(node)
        return node

    for start, end, name, attributes, closing in _tags(page):
        if start < at:  # inside an element without markup
            continue
        text(page[at:start])
        at = end
        if not name:
            continue
        if closing:
            depth = tree.last(name)
            if depth:
                tree.close(depth)
            elif name == "p":
                tree.nodes[-1].items.append(" ")
            continue
        bare = attributes.rstrip().endswith("/")
        if name in RAW and not (bare and tree.last("svg", "math")):
            over = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(page, end)
            at = over.end() if over else len(page)
            continue
        if name in ("html", "body", "head"):
            if tree.nodes[-1].tag == "head":
                tree.close(len(tree.nodes) - 1)
            if name == "head":
                begin("head", "")
            continue
        if tree.nodes[-1].tag == "head" and name not in ("meta", "link", "base"):
            tree.close(len(tree.nodes) - 1)
        if name in BLOCK and (depth := tree.last("p")) and tree.blocks[-1] == depth:  # an open p ends before a block
            tree.close(depth)
        if name in ENDS:
            over, within = ENDS[name]
            if depth := tree.first_below(tree.last(*within), *over):
                tree.close(depth)
        if name in ("br", "hr"):
            tree.nodes[-1].items.append(" ")
        elif name not in VOID:
            begin(name, attributes)
            if bare and name not in BLOCK:
                tree.close(len(tree.nodes) - 1)
    text(page[at:])
    return root


def _walk(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.tag in SILENT:
            continue
        out.append(n)
        stack.extend(reversed(n.children))
    return out


FEATURES = 6 + len(TAGS) + 2 * len(KINDS) + 22


def features(root: Node) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
    """(nodes in page order, their features, number of each one's parent, characters of text of their own)."""
    nodes = _walk(root)
    n = len(nodes)
    number = {id(x): k for k, x in enumerate(nodes)}
    parent = np.array([number[id(x.parent)] if x.parent is not None else -1 for x in nodes])
    depth, chars, commas, digits, marks = (np.zeros(n) for _ in range(5))
    link, blocks, paras, size = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    above: list[frozenset] = [frozenset()] * n
    own, before = np.zeros(n), np.zeros(n)
    total = 0.0
    for k, x in enumerate(nodes):
        p = parent[k]
        if p >= 0:
            depth[k] = depth[p] + 1
            above[k] = above[p] | nodes[p].hints
        before[k] = total
        for t in x.items:
            if isinstance(t, str):
                m = len(t) - t.count(" ") * (len(t) == 1)
                own[k] += m
                total += m
                commas[k] += t.count(",") + t.count(".") + t.count("、") + t.count("。")
                marks[k] += t.count("©") + t.count("|") + t.count("»") + t.count("·")
                digits[k] += sum(map(t.count, "0123456789"))
        if x.tag in BLOCK:
            blocks[k] = 1
        if x.tag == "p":
            paras[k] = own[k] > 0
    chars[:] = own
    inlink = np.zeros(n, bool)
    for k in range(n):
        inlink[k] = nodes[k].tag == "a" or parent[k] >= 0 and inlink[parent[k]]
    link[:] = own * inlink
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for a in (chars, commas, digits, marks, link, blocks, paras, size):
            a[p] += a[k]
    kids = np.array([len(x.children) for x in nodes], float)
    index = np.zeros(n)
    same = np.zeros(n)
    most = np.zeros(n)
    for x in nodes:
        tags: dict[str, int] = {}
        inner = [c for c in x.children if c.tag not in SILENT]
        for c in inner:
            tags[c.tag] = tags.get(c.tag, 0) + 1
        top = max((chars[number[id(c)]] for c in inner), default=0.0)
        for i, c in enumerate(inner):
            k = number[id(c)]
            index[k], same[k] = i / max(1, len(inner) - 1), tags[c.tag] / len(inner)
            most[k] = chars[k] / top if top else 0.0
    up = np.maximum(parent, 0)
    whole = max(total, 1.0)
    out = np.zeros((n, FEATURES), np.float32)
    columns = [
        depth, np.log1p(chars), np.log1p(own), link / np.maximum(chars, 1), commas / np.maximum(chars, 1) * 100, digits / np.maximum(chars, 1),
        marks, np.log1p(blocks), np.log1p(paras), np.log1p(size), chars / np.maximum(size, 1), kids, index, same, most, chars / whole,
        chars / np.maximum(chars[up], 1), before / whole, (before + chars) / whole, np.log1p(chars[up]), link[up] / np.maximum(chars[up], 1), np.log1p(paras[up]),
        own / np.maximum(chars, 1), np.log1p(whole), np.log1p(commas), chars / np.maximum(blocks, 1), inlink.astype(float), np.log1p(link),
    ]
    for c, values in enumerate(columns):
        out[:, c] = values
    base = len(columns)
    for k, x in enumerate(nodes):
        if x.tag in TAGS:
            out[k, base + TAGS.index(x.tag)] = 1
        for h in x.hints:
            out[k, base + len(TAGS) + KINDS.index(h)] = 1
        for h in above[k]:
            out[k, base + len(TAGS) + len(KINDS) + KINDS.index(h)] = 1
    return nodes, out, parent, own


class Boosted:
    """Regression trees boosted on the logistic loss, over binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        f = np.full(len(y), np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight))))
        self.start, self.model = float(f[0]), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            for level in range(self.depth):
                first, m = 2**level - 1, 2**level
                gain_best, split = np.zeros(m), [None] * m
                for c in range(x.shape[1]):
                    b = len(self.edges[c]) + 1
                    if b < 2:
                        continue
                    key = leaf * b + codes[:, c]
                    gs = np.bincount(key, g, m * b).reshape(m, b).cumsum(1)
                    hs = np.bincount(key, h, m * b).reshape(m, b).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 2) | (ht - hs < 2)] = 0
                    k = gain[:, :-1].argmax(1)
                    for q in range(m):
                        if gain[q, k[q]] > gain_best[q] + 1e-9:
                            gain_best[q], split[q] = gain[q, k[q]], (c, k[q])
                right = np.zeros(len(y), bool)
                for q in range(m):
                    if split[q]:
                        feature[first + q], cut[first + q] = split[q][0], self.edges[split[q][0]][split[q][1]]
                        mine = leaf == q
                        right[mine] = codes[mine, split[q][0]] > split[q][1]
                leaf = 2 * leaf + right
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            f = f + value[leaf]
            self.model.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.model:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                c = feature[at]
                at = 2 * at + 1 + ((c >= 0) & (x[rows, np.maximum(c, 0)] > cut[at]))
            f += value[at - (2**self.depth - 1)]
        return f


def decode(log_odds: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The best labelling in which no element inside a dropped one is kept. Parents come before their children."""
    gain = log_odds * weight
    inside, outside = gain.copy(), -gain
    for k in range(len(gain) - 1, 0, -1):
        inside[parent[k]] += max(inside[k], outside[k])
        outside[parent[k]] += outside[k]
    keep = np.zeros(len(gain), bool)
    for k in range(len(gain)):
        keep[k] = inside[k] >= outside[k] and (k == 0 or keep[parent[k]])
    return keep


def render(nodes: list[Node], keep: np.ndarray) -> str:
    kept = {id(x) for x, k in zip(nodes, keep) if k}
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = "".join(line).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    stack: list = [("open", nodes[0])]
    while stack:
        what, x = stack.pop()
        if what == "text":
            line.append(x)
        elif what == "flush":
            flush()
        elif id(x) in kept:
            if x.tag in BLOCK:
                flush()
                stack.append(("flush", None))
            stack.extend(("text", t) if isinstance(t, str) else ("open", t) for t in reversed(x.items))
        else:
            line.append(" ")
    flush()
    return " ".join(blocks)


# ---- pages whose truth is known

_SYLLABLES = "ka lo mi ren tu sal vor den pi as ort el un ga shi bra".split()


class _Composer:
    """Composes pages; ("in", ...) marks what belongs to the article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
        text = " ".join(w + (r.choice([",", ".", ""]) if r.random() < 0.12 else "") for w in out)
        if r.random() < 0.05:
            text = text.upper()
        if r.random() < 0.05:
            text = " ".join(w + r.choice(["!!", "***", "###", "%%%", " |"]) for w in text.split())
        return text[:1].upper() + text[1:] + r.choice([".", "", "!"])

    def attributes(self, *kinds: str, chance: float = 0.8) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        token = r.choice(HINTS[r.choice(kinds)].split())
        return f' {r.choice(["class", "class", "id", "role"])}="{token}{r.choice(["", "", "-wrap", " col", " x1"])}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n))

    def menu(self) -> str:
        r = self.r
        tag = r.choice(["nav", "nav", "div", "ul"])
        hint = "" if tag == "nav" and r.random() < 0.5 else self.attributes("menu", chance=1)
        inner = self.links(r.randint(2, 9))
        return f"<{tag}{hint}>{inner if tag == 'ul' else '<ul>' + inner + '</ul>'}</{tag}>"

    def other(self) -> str:
        r = self.r
        kind = r.choice(["advert", "advert", "side", "comment", "notice", "share", "form", "header", "byline2"])
        if kind == "form":
            return f"<form{self.attributes('form', chance=0.5)}><label>{self.words(1, 4)}</label><input><p>{self.words(2, 8)}</p></form>"
        if kind == "comment":
            body = "".join(f"<{t}{self.attributes('comment', chance=0.4)}><p>{self.words(4, 40)}</p></{t}>" for t in [r.choice(["div", "li", "article"])] * r.randint(1, 5))
            return f"<{(t := r.choice(['section', 'div', 'div']))}{self.attributes('comment', chance=1)}>{'<h3>' + self.words(1, 3) + '</h3>' if r.random() < 0.5 else ''}{body}</{t}>"
        if kind == "side":
            tag = r.choice(["aside", "aside", "div", "section"])
            return f"<{tag}{self.attributes('side', chance=0.5 if tag == 'aside' else 1)}><h3>{self.words(1, 4)}</h3>{'<ul>' + self.links(r.randint(2, 6)) + '</ul>' if r.random() < 0.6 else '<p>' + self.words(5, 40) + '</p>'}</{tag}>"
        if kind == "header":
            return f"<header{self.attributes('header', chance=0.4)}><{(h := r.choice(['h1', 'div', 'p']))}>{self.words(1, 5)}</{h}>{self.menu() if r.random() < 0.5 else ''}</header>"
        if kind == "share":
            return f"<div{self.attributes('share', chance=1)}>{''.join(f'<a href=#>{self.words(1, 1)}</a> ' for _ in range(3))}</div>"
        tag = r.choice(["div", "div", "p", "section", "aside", "span"])
        hint = self.attributes("advert" if kind != "notice" else "notice", chance=1)
        text = self.words(2, 30)
        return f"<{tag}{hint}>{'<p>' + text + '</p>' if tag in ('div', 'section') and r.random() < 0.3 else text}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = r.choice(["footer", "footer", "footer", "div"])
        hint = self.attributes("footer", chance=0.3 if tag == "footer" else 1)
        return f"<{tag}{hint}>{r.choice(['&copy; ', '', '&middot; '])}{self.words(2, 25)}{'<ul>' + self.links(3) + '</ul>' if r.random() < 0.3 else ''}</{tag}>"

    def block(self) -> str:
        r, k = self.r, self.r.random()
        text = self.words(*r.choice([(1, 3), (5, 40), (20, 120), (20, 120), (60, 200)]))
        if r.random() < 0.15:
            half = len(text) // 2
            text = f"{text[:half]}<{(t := r.choice(['b', 'em', 'i', 'a href=/x', 'span']))}>{text[half:]}</{t.split()[0]}>"
        if k < 0.72:
            return f"<p>{'<b>' if r.random() < 0.1 else ''}{text}{'<br>' if r.random() < 0.1 else ''}{'</p>' if r.random() < 0.9 else ''}"
        if k < 0.82:
            return f"<{(h := r.choice(['h2', 'h3']))}>{self.words(1, 8)}</{h}>"
        if k < 0.88:
            return "<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.92:
            return f"<blockquote><p>{text}</p></blockquote>"
        if k < 0.95:
            return f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>"
        if k < 0.97:
            return f"<pre>{text}</pre>"
        return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>"

    def page(self) -> str:
        """A page; the article lies between the marks \\x01 and \\x02, pieces to drop inside it between \\x03 and \\x04."""
        r = self.r
        n = r.choice([1, 1, 2, 3, 5, 8, 14, 25])
        inner = f"<h1>{self.words(2, 10)}</h1>" if r.random() < 0.85 else ""
        if r.random() < 0.15:
            inner = f"<header>{inner}</header>"
        for _ in range(n):
            inner += self.block()
            if r.random() < 0.05:
                inner += "\x03" + self.other() + "\x04"
        wrap = r.choice(["article", "article", "article", "main", "div", "section"])
        hint = self.attributes("content", chance=0.25 if wrap in ("article", "main") else 0.95)
        body = f"<{wrap}{hint}>\x01{inner}\x02</{wrap}>"
        if r.random() < 0.25:
            body = f"<{(t := r.choice(['main', 'div']))}{self.attributes('content', chance=0.4)}>{body}{'' if r.random() < 0.6 else self.other()}</{t}>"
        head = [self.menu()] if r.random() < 0.85 else []
        head += [self.other() for _ in range(r.choice([0, 1, 1, 2]))]
        r.shuffle(head)
        tail = [self.other() for _ in range(r.choice([0, 0, 1, 2]))] + ([self.footer()] if r.random() < 0.9 else [])
        if r.random() < 0.3:
            return f"<div>{''.join(head)}{body}{''.join(tail)}</div>"
        return "".join(head) + body + "".join(tail)


def labelled(page: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, truth, weight) of a composed page's elements."""
    root = parse(page)
    inside, cut, truth = False, 0, {}
    stack: list = [root]
    order: list = []
    while stack:  # in page order, with texts, to see the marks
        x = stack.pop()
        order.append(x)
        if isinstance(x, Node):
            stack.append(("end", x))
            if x.tag not in SILENT:
                stack.extend(reversed(x.items))
    kept: dict[int, float] = {}
    dropped: dict[int, float] = {}
    path: list[Node] = []
    for x in order:
        if isinstance(x, Node):
            path.append(x)
        elif isinstance(x, tuple):
            path.pop()
        else:
            run = 0
            for ch in x:
                if ch in "\x01\x02\x03\x04":
                    for p in path:
                        (kept if inside and not cut else dropped)[id(p)] = (kept if inside and not cut else dropped).get(id(p), 0) + run
                    run = 0
                    inside = inside if ch in "\x03\x04" else ch == "\x01"
                    cut += {"\x03": 1, "\x04": -1}.get(ch, 0)
                else:
                    run += not ch.isspace()
            for p in path:
                (kept if inside and not cut else dropped)[id(p)] = (kept if inside and not cut else dropped).get(id(p), 0) + run
    for x in _walk(root):
        x.items = [t.translate(_MARKS) if isinstance(t, str) else t for t in x.items]
    nodes, x, _, own = features(root)
    y = np.array([kept.get(id(k), 0) > 0 for k in nodes], float)
    mixed = np.array([kept.get(id(k), 0) > 0 and dropped.get(id(k), 0) > 0 for k in nodes])
    return x, y, np.where(mixed, 0.5, 1.0)


_MARKS = {1: None, 2: None, 3: None, 4: None}
PAGES = 700


@lru_cache(1)
def trained() -> Boosted:
    composer = _Composer(20)
    parts = [labelled(composer.page()) for _ in range(PAGES)]
    return Boosted().fit(*(np.concatenate([p[k] for p in parts]) for k in range(3)))


def extract(pages: list[str], model: Boosted) -> list[str]:
    trees = [features(parse(p)) for p in pages]
    if not trees:
        return []
    odds = model.predict(np.concatenate([t[1] for t in trees]))
    out, at = [], 0
    for nodes, x, parent, own in trees:
        scores = np.clip(odds[at : at + len(nodes)], -6, 6)
        at += len(nodes)
        hidden = np.array([n.hidden for n in nodes])
        scores[hidden] = -6
        weight = 0.1 + np.log1p(own)
        scores[0] = abs(scores[0])  # the page itself is never dropped as one
        out.append(render(nodes, decode(scores, parent, weight)))
    return out


def _extract_of(model: Boosted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                found = extract(list(part.html), model)
                yield pd.DataFrame({"page_id": part.page_id.astype("Int64"), "url": part.url, "text": found, "n_chars": [len(t) for t in found]})

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInPandas(tidy(_extract_of(trained())), "page_id long, url string, text string, n_chars long")
