"""Main text of web pages by boosted trees over DOM nodes (operator 10).

A tolerant reader turns a page into nodes and runs of text. Each node gets features of itself, of its
subtree (text and link density, tags per text), of its place (depth, siblings) and of its and its
ancestors' attribute tokens. Gradient-boosted trees give the odds that a node's own text is main text, and a
tree pass then keeps or drops subtrees so that the summed odds are greatest: what lies in a dropped node
is dropped, so choices along a path never contradict each other.

The trees are learned on a fixed number of made-up pages (`LEARN_PAGES`) whose parts are known: menus, notices,
adverts, forms, sidebars, comments, footers, and articles in various mark-up. No page of the input is
used. The model is small and goes out with the tasks; extraction is a function of one row, without shuffle.

Defined cases: a null or empty page, or one without main text, gives an empty text; broken or cut mark-up is
read as far as it goes; a tag with an unclosed quote ends at its next `>`, one that the page breaks off in is no text; long
mark-up of any kind is read in linear time, its nodes take about 1 kB each while their page is read; a head without its end tag ends where its content ends, an unclosed button, select,
object or svg at the next block; mark-up inside scripts, styles and comments is no text; repeated rows are read
alike; an empty table gives an empty result; further columns are kept by `extract`, clashing names
replaced.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import enter, on_leave, read

LEARN_PAGES = 400
TREES = 40
DEPTH = 4
RATE = 0.3
BUCKETS = 96
#: Attribute values, tags and rows of them that a worker keeps, and the longest values kept; others are read anew.
KEPT_VALUES = 10_000
KEPT_VALUE_CHARS = 500
#: Bytes of pages whose nodes are held together, and nodes whose features go through the trees at once.
HELD_CHARS = 1 << 20
NODES_AT_ONCE = 4096

#: A tag whose quotes all close as values do, or what else begins with a bracket; never goes back over what it has read.
_OPEN = re.compile(r"""<(/?[a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"(?=[ \t\n\r\f/>])|'[^']*+'(?=[ \t\n\r\f/>]))*+)>|<(?=[!?]|/?[a-zA-Z])""")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_END_OR_QUOTE = re.compile("[>\"']")
_AFTER_VALUE = frozenset(" \t\n\r\x0c/>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
#: Elements without content, elements whose content is not text, elements that stand as blocks.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "noscript", "template", "head", "title", "svg", "iframe", "object", "select", "button", "textarea"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Start tags that may stand in a head; any other, or text, ends it where its end tag is left out.
_IN_HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template"}
#: Elements that hide what is in them and that, where their end tag is missing, end at the next block.
_LEFT_OPEN = {"button", "select", "object", "svg"}
_ENDS_LEFT_OPEN = _ENDS_P | {"body", "dd", "dt", "li", "td", "th", "tr"}
#: Groups of tags that the trees see as yes or no.
_GROUPS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "input", "button", "select", "label", "textarea"}, {"article"}, {"main"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"}, {"table", "tbody", "tr", "td", "th"}, {"div", "section"}, {"blockquote", "pre", "figure", "figcaption"}, {"a"}, {"b", "i", "em", "strong", "span", "u", "small", "code"}, {"body", "html"}]


@dataclass
class Page:
    """Nodes in page order (parents first) and runs of text with their node."""

    tags: list[str]
    parents: list[int]
    tokens: list[tuple[str, ...]]
    ends: list[int]
    runs: list[tuple[int, str]]
    breaks: list[int]  # how many blocks begin or end before each run


def _attribute_tokens(text: str) -> tuple[str, ...]:
    """Words of the class, id and role values among a tag's attributes, however long these be."""
    values = tuple(m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text))
    if not values:
        return ()
    return _value_tokens(values) if sum(map(len, values)) <= KEPT_VALUE_CHARS else _value_tokens.__wrapped__(values)


@lru_cache(maxsize=KEPT_VALUES)
def _value_tokens(values: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted({t.lower() for v in values for t in _TOKEN.findall(v)}))


class _Tags:
    """Reads tags one after another, each part of the source a bounded number of times."""

    def __init__(self, source: str):
        self.source = source
        self.last_end = source.rfind(">")
        self.last = {q: source.rfind(q) for q in "\"'"}

    def end_of(self, at: int) -> int:
        """Where the `>` of the tag stands whose name ends at `at`; -1 if it has none.

        A quote counts where its twin follows and ends a value; else the tag ends at the next `>`, as if it were not there.
        """
        source = self.source
        while at <= self.last_end:
            m = _END_OR_QUOTE.search(source, at)
            if m is None or m[0] == ">":
                return -1 if m is None else m.start()
            twin = source.find(m[0], m.end()) if m.end() <= self.last[m[0]] else -1
            if twin < 0 or source[twin + 1 : twin + 2] not in _AFTER_VALUE:
                return source.find(">", m.end())
            at = twin + 1
        return -1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        """(start, end, name, attributes) of the next tag, comment or declaration; the name of an end tag begins with a
        slash, those of comments and declarations and of a tag that the page breaks off in are empty."""
        source = self.source
        m = _OPEN.search(source, at)
        if m is None:
            return None
        if m[1] is not None:
            return m.start(), m.end(), m[1].lower(), m[2]
        begin = m.start()
        if source.startswith("<!--", begin):
            end = source.find("-->", begin + 4)
            return begin, end + 3 if end >= 0 else len(source), "", ""
        name = _NAME.match(source, begin + 1)
        if name is None:
            end = source.find(">", begin) if begin < self.last_end else -1
            return begin, end + 1 if end >= 0 else len(source), "", ""
        end = self.end_of(name.end())
        if end < 0:
            return begin, len(source), "", ""
        return begin, end + 1, name[0].lower(), source[name.end() : end]


def parse(source: str | None) -> Page:
    page, left_open = _parsed(source or "", frozenset())
    return _parsed(source or "", left_open)[0] if left_open else page


def _parsed(source: str, left_open: frozenset[int]) -> tuple[Page, frozenset[int]]:
    """The page, and where in the source the elements of `_LEFT_OPEN` without an end tag begin; given ones end at a block."""
    tags, parents, tokens, ends = ["#page"], [-1], [()], [0]
    runs: list[tuple[int, str]] = []
    breaks: list[int] = []
    stack, block, at = [0], 0, 0
    open_now: defaultdict[str, int] = defaultdict(int)
    begun: dict[int, int] = {}
    waiting: list[tuple[int, int]] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            ends[node] = len(tags)
            open_now[tags[node]] -= 1

    def text(a: int, b: int) -> None:
        if b > a:
            if tags[stack[-1]] == "head" and not source[a:b].isspace():
                close(len(stack) - 1)
            runs.append((stack[-1], source[a:b]))
            breaks.append(block)

    reader = _Tags(source)
    while (found := reader.next(at)) is not None:
        begin, after, tag, attributes = found
        text(at, begin)
        at = after
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag not in _INLINE:
                block += 1
            if open_now[tag]:
                for d in range(len(stack) - 1, 0, -1):
                    if tags[stack[d]] == tag:
                        begun.pop(stack[d], None)
                        close(d)
                        break
            continue
        if tags[stack[-1]] == "head" and tag not in _IN_HEAD:
            close(len(stack) - 1)
        if tag not in _INLINE:
            block += 1
        if left_open and tag in _ENDS_LEFT_OPEN:
            for d, node in waiting:
                if d < len(stack) and stack[d] == node:
                    close(d)
                    break
            waiting.clear()
        if tag in _ENDS_P and open_now["p"]:
            for d in range(len(stack) - 1, 0, -1):
                if tags[stack[d]] == "p":
                    close(d)
                    break
                if tags[stack[d]] not in _INLINE:
                    break
        if tag in _SAME and any(open_now[t] for t in _SAME[tag]):
            for d in range(len(stack) - 1, 0, -1):
                if tags[stack[d]] in _STOPS[tag]:
                    break
                if tags[stack[d]] in _SAME[tag]:
                    close(d)
                    break
        tags.append(tag)
        parents.append(stack[-1])
        tokens.append(_attribute_tokens(attributes) if "=" in attributes else ())
        ends.append(len(tags))
        if tag == "br":
            runs.append((stack[-1], " "))
            breaks.append(block)
        if tag in _VOID or attributes.endswith("/"):
            continue
        stack.append(len(tags) - 1)
        open_now[tag] += 1
        if tag in _LEFT_OPEN:
            begun[stack[-1]] = begin
            if begin in left_open:
                waiting.append((len(stack) - 1, stack[-1]))
        if tag in _RAW:
            low = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
            at = low.start() if low else len(source)
    text(at, len(source))
    close(0)
    return Page(tags, parents, tokens, ends, runs, breaks), frozenset(begun.values())


@lru_cache(maxsize=KEPT_VALUES)
def _tag_row(tag: str) -> np.ndarray:
    return np.array([tag in g for g in _GROUPS], bool)


@lru_cache(maxsize=KEPT_VALUES)
def _token_row(tokens: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(BUCKETS, bool)
    for t in tokens:
        out[zlib.crc32(t.encode()) % BUCKETS] = True
    return out


def _forget() -> None:
    for kept in (_value_tokens, _tag_row, _token_row):
        kept.cache_clear()


on_leave("pages", _forget)


@dataclass
class Nodes:
    """What the trees see of a page's nodes: yes or no in a byte each, numbers, and the characters of each node's own text."""

    flags: list[np.ndarray]
    numbers: np.ndarray
    own: np.ndarray

    def rows(self, at: np.ndarray) -> np.ndarray:
        """A row of features for each of some nodes."""
        return np.concatenate([*(x[at] for x in self.flags), self.numbers[at]], axis=1)


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(a row per node, characters of each node's own text)."""
    nodes = described(page)
    return nodes.rows(np.arange(len(nodes.own))), nodes.own


def described(page: Page) -> Nodes:
    n = len(page.tags)
    parent = np.array(page.parents)
    end = np.array(page.ends)
    own, stops = np.zeros(n + 1), np.zeros(n + 1)
    for node, run in page.runs:
        bare = run.strip()
        if bare:
            own[node] += len(bare)
            stops[node] += bare.count(".") + bare.count(",")
    hidden = np.array([t in _HIDDEN for t in page.tags])
    groups = np.stack([_tag_row(t) for t in page.tags])
    marks = np.stack([_token_row(t) for t in page.tokens])
    link = groups[:, 14] > 0
    above = np.zeros_like(groups)
    above_marks = np.zeros_like(marks)
    depth = np.zeros(n)
    in_link = link.copy()
    for i in range(1, n):
        p = page.parents[i]
        above[i] = np.maximum(above[p], groups[p])
        if page.tokens[p] or above_marks[p].any():
            above_marks[i] = np.maximum(above_marks[p], marks[p])
        depth[i] = depth[p] + 1
        in_link[i] |= in_link[p]
        hidden[i] |= hidden[p]
    own[:n][hidden] = 0
    sums = np.concatenate([[0], np.cumsum(own[:n])])
    links = np.concatenate([[0], np.cumsum(np.where(in_link, own[:n], 0))])
    punct = np.concatenate([[0], np.cumsum(stops[:n])])
    at = np.arange(n)
    chars, link_chars, marks_in = sums[end] - sums[at], links[end] - links[at], punct[end] - punct[at]
    size = end - at
    kids = np.bincount(parent[1:], minlength=n)
    up = np.maximum(parent, 0)
    first = np.zeros(n)
    place: dict[int, int] = {}
    same: dict[tuple[int, str], int] = {}
    for i, (p, t) in enumerate(zip(page.parents, page.tags, strict=True)):
        first[i] = place.get(p, 0)
        place[p] = int(first[i]) + 1
        same[p, t] = same.get((p, t), 0) + 1
    alike = np.array([same[p, t] for p, t in zip(page.parents, page.tags, strict=True)], float)
    whole = max(chars[0], 1)
    siblings = np.maximum(kids[up], 1)
    parent_chars = np.maximum(chars[up], 1)
    columns = (np.log1p(own[:n]), np.log1p(chars), link_chars / np.maximum(chars, 1), size / np.maximum(chars, 1), marks_in / np.maximum(chars, 1), depth, first / siblings, np.log1p(siblings), alike / siblings, chars / parent_chars, chars / whole, link_chars[up] / parent_chars, kids, in_link.astype(float), sums[at] / whole)
    numbers = np.empty((n, len(columns)), np.float32)
    for k, column in enumerate(columns):
        numbers[:, k] = column
    return Nodes([groups, above, marks, above_marks], numbers, own[:n])


class Trees:
    """Boosted regression trees on the logistic loss; a tree is arrays of features, cuts and leaves."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Trees by histograms of at most 32 bins a feature."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(d)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    inner = 2**DEPTH - 1
    share = float(weight @ y / weight.sum())
    score = np.full(n, np.log(share / (1 - share)))
    base = float(score[0])
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    flat = bins + 33 * np.arange(d)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for k in range(inner):
            pick = node == k
            best, choice = 1e-6, None
            if pick.any():
                where = flat[pick].reshape(-1)
                gs = np.bincount(where, np.repeat(g[pick], d), 33 * d).reshape(d, 33).cumsum(axis=1)
                hs = np.bincount(where, np.repeat(h[pick], d), 33 * d).reshape(d, 33).cumsum(axis=1)
                total_g, total_h = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                for j in range(d):
                    gain[j, len(edges[j]) :] = 0
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] > best:
                    choice = j, float(edges[j][b])
            if choice:
                feature[k], cut[k] = choice
            node = np.where(pick, 2 * k + 1 + (x[:, feature[k]] > cut[k]), node)
        where = node - inner
        leaf = -RATE * np.bincount(where, g, 2**DEPTH) / (np.bincount(where, h, 2**DEPTH) + 1)
        score += leaf[where]
        trees.append((feature, cut, leaf))
    return Trees(base, *(np.stack(v) for v in zip(*trees, strict=True)))


class _Maker:
    """Pages with known parts; a run of text is marked as main by a private character before it."""

    MAIN = "\ue000"
    SYLLABLES = ["ta", "ren", "ko", "mi", "ous", "del", "ar", "in", "sto", "ve", "qui", "lan", "er", "ba", "num", "é", "ich", "or", "un", "si"]
    OFF = ["nav", "menu", "sidebar", "footer", "header", "ad", "ads", "advert", "banner", "cookie", "notice", "promo", "share", "social", "related", "comments", "comment", "widget", "breadcrumb", "login", "search", "subscribe", "newsletter", "popup", "toolbar", "sponsor", "consent", "reply", "respond", "pagination"]
    ON = ["article", "content", "post", "entry", "main", "story", "body", "text", "page"]
    PLAIN = ["row", "col", "wrap", "container", "box", "inner", "left", "grid", "block", "section"]

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def words(self, a: int, b: int) -> str:
        out = []
        for _ in range(int(self.r.integers(a, b + 1))):
            w = "".join(self.pick(self.SYLLABLES) for _ in range(int(self.r.integers(1, 4))))
            out.append(w + self.pick(["", "", "", "", "", "", ",", "."]))
        s = " ".join(out)
        return s[:1].upper() + s[1:] + self.pick([".", ".", ""])

    def named(self, names, p: float = 0.7) -> str:
        if self.r.random() > p:
            return ""
        name = self.pick(names) + self.pick(["", "-" + self.pick(self.PLAIN), " " + self.pick(self.PLAIN)])
        both = f' id="{self.pick(names)}"' if self.r.random() < 0.1 else ""
        return f'{both} {"class" if both else self.pick(["class", "id"])}="{name}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    def off(self) -> str:
        kind = int(self.r.integers(11))
        n = int(self.r.integers(2, 9))
        if kind == 0:
            return f"<nav{self.named(['nav', 'menu'], 0.4)}><ul>{self.links(n)}</ul></nav>"
        if kind == 1:
            return f"<div{self.named(['nav', 'menu', 'toolbar', 'breadcrumb', 'pagination'], 0.95)}>" + "".join(f'<a href="#">{self.words(1, 2)}</a> ' for _ in range(n)) + "</div>"
        if kind == 2:
            inner = self.words(3, 20) if self.r.random() < 0.5 else f"<p>{self.words(5, 25)}</p>"
            return f'<div{self.named(["ad", "ads", "advert", "sponsor", "promo", "banner"], 1)}>{inner}</div>'
        if kind == 3:
            return f"<footer{self.named(['footer'], 0.3)}>{self.pick(['<p>', ''])}&copy; {self.words(3, 20)}</footer>"
        if kind == 4:
            return f"<header{self.named(['header', 'banner'], 0.3)}>{self.pick(['<h1>', '<div>', '<p>'])}{self.words(1, 6)}{self.pick(['', '<ul>' + self.links(3) + '</ul>'])}</header>"
        if kind == 5:
            return f"<aside{self.named(['sidebar', 'widget', 'related'], 0.5)}><h3>{self.words(1, 4)}</h3><p>{self.words(5, 40)}</p><ul>{self.links(n)}</ul></aside>"
        if kind == 6:
            return f"<form{self.named(['search', 'login', 'subscribe', 'newsletter'], 0.5)}><label>{self.words(1, 3)}</label><input name=q><p>{self.words(3, 15)}</p><button>{self.words(1, 2)}</button></form>"
        if kind == 7:
            return f'<div{self.named(["cookie", "notice", "consent", "popup"], 1)}><p>{self.words(8, 40)}</p><button>{self.words(1, 1)}</button></div>'
        if kind == 8:
            items = "".join(f'<{t}{self.named(["comment", "reply"], 0.8)}><b>{self.words(1, 2)}</b><p>{self.words(5, 50)}</p></{t}>' for t in [self.pick(["li", "div", "article"])] * n)
            return f'<{self.pick(["section", "div", "ol"])}{self.named(["comments", "respond"], 1)}><h3>{self.words(1, 3)}</h3>{items}</div>'
        if kind == 9:
            return f'<div{self.named(["sidebar", "related", "widget", "share", "social"], 1)}><h4>{self.words(1, 4)}</h4><p>{self.words(5, 40)}</p><ul>{self.links(n)}</ul></div>'
        return f'<div{self.named(["footer", "header", "login", "search"], 1)}>{self.words(2, 20)}</div>'

    def block(self) -> str:
        m, kind = self.MAIN, self.r.random()
        if kind < 0.6:
            mid = f' <a href="/x">{m}{self.words(1, 3)}</a> {m}' if self.r.random() < 0.25 else ""
            return f"<p>{m}{self.words(1, 90)}{mid}{self.words(1, 20)}</p>"
        if kind < 0.72:
            return f"<p><b>{m}{self.words(2, 60)}<br>" + ("</b></p>" if self.r.random() < 0.5 else "")
        if kind < 0.82:
            return f"<h2>{m}{self.words(1, 8)}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{m}{self.words(2, 25)}</li>" for _ in range(int(self.r.integers(2, 6)))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote>{m}{self.words(5, 40)}</blockquote>"
        return "<table>" + "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>"

    def page(self) -> str:
        body = [self.block() for _ in range(int(self.r.integers(0, 13)))]
        for _ in range(int(self.r.integers(0, 3))):
            if self.r.random() < 0.35:
                body.insert(int(self.r.integers(len(body) + 1)), self.off())
        head = f"<h1>{self.MAIN}{self.words(1, 12)}</h1>"
        kind = self.r.random()
        tag = "article" if kind < 0.55 else "main" if kind < 0.7 else "section" if kind < 0.8 else "div"
        art = f"<{tag}{self.named(self.ON, 0.3 if tag in ('article', 'main') else 1)}>{head}{''.join(body)}</{tag}>"
        if kind >= 0.93:
            art = head + "".join(body)
        for _ in range(int(self.r.integers(0, 3)) if kind < 0.97 else 0):
            t = self.pick(["div", "main", "section"])
            beside = self.off() if self.r.random() < 0.2 else ""
            art = f"<{t}{self.named(self.PLAIN + self.ON, 0.6)}>{art}{beside}</{t}>"
        before = "".join(self.off() for _ in range(int(self.r.integers(0, 4))))
        after = "".join(self.off() for _ in range(int(self.r.integers(0, 4))))
        out = f"<html><head><title>{self.words(2, 8)}</title><script>var a='<p>';</script></head><body>{before}{art}{after}</body></html>"
        return out if self.r.random() > 0.1 else out[: int(len(out) * self.r.uniform(0.5, 1))]


def learn(n_pages: int = LEARN_PAGES, seed: int = 1) -> Trees:
    maker = _Maker(seed)
    xs, ys, ws = [], [], []
    for _ in range(n_pages):
        page = parse(maker.page())
        main = np.zeros(len(page.tags))
        for node, run in page.runs:
            if maker.MAIN in run:
                main[node] = 1
        page.runs = [(node, run.replace(maker.MAIN, "")) for node, run in page.runs]
        x, own = features(page)
        pick = own > 0
        xs.append(x[pick])
        ys.append(main[pick])
        ws.append(np.full(int(pick.sum()), 1.0))
    return fit_trees(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def chosen(page: Page, own: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Nodes to keep: the choice of subtrees with the greatest summed odds of nodes that have text."""
    n = len(page.tags)
    gain = np.where(own > 0, odds, 0.0).tolist()
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[page.parents[i]] += gain[i]
    keep = np.zeros(n, bool)
    keep[0] = gain[0] > 0
    for i in range(1, n):
        keep[i] = keep[page.parents[i]] and gain[i] > 0
    return keep & (own > 0)


def render(page: Page, keep: np.ndarray) -> str:
    blocks: list[str] = []
    last, parts = None, []
    for (node, run), b in zip(page.runs, page.breaks, strict=True):
        if not keep[node]:
            continue
        if b != last:
            blocks.append("".join(parts))
            parts, last = [], b
        parts.append(run)
    blocks.append("".join(parts))
    clean = (_SPACE.sub(" ", html_lib.unescape(x)).strip() for x in blocks)
    return "\n\n".join(x for x in clean if x)


def odds_of(pages: list[Nodes], trees: Trees) -> list[np.ndarray]:
    """Odds of all nodes that have text, those of small pages together and of large ones in parts; others have 0."""
    out = [np.zeros(len(p.own)) for p in pages]
    waiting: list[tuple[int, np.ndarray]] = []

    def judge() -> None:
        odds = trees.odds(np.concatenate([pages[k].rows(at) for k, at in waiting])) if waiting else []
        begin = 0
        for k, at in waiting:
            out[k][at] = odds[begin : begin + len(at)]
            begin += len(at)
        waiting.clear()

    for k, p in enumerate(pages):
        with_text = np.flatnonzero(p.own > 0)
        for a in range(0, len(with_text), NODES_AT_ONCE):
            waiting.append((k, with_text[a : a + NODES_AT_ONCE]))
            if sum(len(at) for _, at in waiting) >= NODES_AT_ONCE:
                judge()
    judge()
    return out


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    read_ = [parse(s) for s in sources]
    nodes = [described(p) for p in read_]
    return [render(p, chosen(p, x.own, odds)) for p, x, odds in zip(read_, nodes, odds_of(nodes, trees), strict=True)]


def _held_together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that are at work at once: at most `HELD_CHARS` in all, but for a page that is longer by itself."""
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > HELD_CHARS:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """pages with `text`, the main text of the whole html, and `n_chars`.

    A worker holds the nodes of `HELD_CHARS` of pages, or of one longer page, at a time.
    """
    held = pages.sparkSession.sparkContext.broadcast((model.base, model.feature, model.cut, model.leaf))

    @F.arrow_udf("string")
    def run(sources: pa.Array) -> pa.Array:
        enter("pages")
        trees, out = Trees(*held.value), []
        sizes = pc.fill_null(pc.binary_length(sources), 0).to_numpy(zero_copy_only=False)
        for a, b in _held_together(sizes):
            out.append(pa.array(main_texts(sources.slice(a, b - a).to_pylist(), trees), pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return pages.drop("text", "n_chars").withColumn("text", run("html")).withColumn("n_chars", F.length("text").cast("long"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, learn()).select("page_id", "url", "text", "n_chars")
