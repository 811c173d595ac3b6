"""Main text of web pages by gradient-boosted trees over DOM-node features, decoded along the tree.

Each block element is a node; inline elements belong to the block around them. The trees score whether a node holds main
text, from its tag, attribute tokens, depth, subtree text, link and punctuation density, siblings and ancestors. The
decoding keeps a node only inside a kept parent and maximises the sum of scores, so no kept node has a dropped ancestor
and no dropped node a kept descendant. The classifier is fitted on pages that `synthetic_page` builds with known labels
(`TRAIN_PAGES` of them, a fixed bound); the table to be extracted is not used for fitting.

Defined cases: null or empty html gives empty text; unclosed, stray and wrongly nested tags are repaired as browsers
mostly do, a head ends where something else than its elements begins; text in formulas, drawings and the fallback of
media is text like any other, while form controls (button, select, textarea) go with forms; noscript is a notice; a page
without elements is one block of text; repeated rows give equal rows; an empty table gives an empty
result; very long pages are read whole, in time linear in their length; a node whose best subtree scores exactly 0 is dropped; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import marked, unmarked

TRAIN_PAGES = 1500
TREES, DEPTH, RATE, BINS = 60, 3, 0.25, 24
#: Stands before every main block of a synthetic page.
MARK = "\ue000"

# HTML's elements by the way they are handled.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noscript noembed noframes".split())
# Not rendered (head, scripts, styles, templates, frames' fallback, annotations), shown without scripts only, or parts of forms.
DROPPED = frozenset("head script style textarea title xmp iframe noscript noembed noframes template annotation annotation-xml desc metadata select option optgroup button datalist".split())
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title html".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"},
}
SCOPE = frozenset("table ul ol dl article section div main aside nav footer header form body html blockquote".split())
# Words in class, id and role attributes, by what they tell.
TOKENS = (
    frozenset("article content main post entry story body text maincontent page".split()),
    frozenset("nav navigation menu navbar breadcrumb breadcrumbs pagination pager toc tabs".split()),
    frozenset("header masthead topbar top logo banner branding".split()),
    frozenset("footer foot bottom copyright legal colophon contentinfo".split()),
    frozenset("sidebar side aside widget rail related recommended recommend trending popular more complementary".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion adsense".split()),
    frozenset("notice cookie cookies consent alert warning popup modal overlay gdpr message toast announcement subscribe paywall".split()),
    frozenset("comment comments reply replies respond discussion disqus responses".split()),
    frozenset("form login signup newsletter search share social sharing buttons meta author byline tags".split()),
)
GROUPS = (
    frozenset("p".split()),
    frozenset("h1 h2 h3 h4 h5 h6 hgroup".split()),
    frozenset("ul ol dl menu dir".split()),
    frozenset("li dt dd".split()),
    frozenset("article main".split()),
    frozenset("nav menu".split()),
    frozenset("header".split()),
    frozenset("footer".split()),
    frozenset("aside dialog".split()),
    frozenset("form fieldset search".split()),
    frozenset("blockquote pre figure figcaption table tbody tr td th caption".split()),
    frozenset("div section center".split()),
    frozenset("html body".split()),
)

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_SIGN = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Nodes (block elements, parents first) and text blocks in page order."""

    tag: list[str] = field(default_factory=lambda: ["#"])
    parent: list[int] = field(default_factory=lambda: [-1])
    attrs: list[str] = field(default_factory=lambda: [""])
    node: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


@dataclass
class Scanner:
    """Finds tags, comments and declarations in time linear in the page, whatever it holds.

    A tag ends at the first `>` outside quotes, or at the first `>` of all if a quote in it is never closed. Quotes from
    which no end can be reached are remembered, so none is followed twice; after the last `>` nothing but comments is looked for.
    """

    source: str
    last: int = field(init=False)
    lost: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.last = self.source.rfind(">")

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether an end tag, name or nothing, attributes) of what comes first from `at` on."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            if at > self.last:
                at = source.find("<!--", at)
                return (at, len(source), False, "", "") if at >= 0 else None
            sign = source[at + 1]
            if sign in "!?":
                comment = source.startswith("!--", at + 1)
                end = source.find("-->", at + 4) if comment else source.find(">", at)
                return at, (end + (3 if comment else 1) if end >= 0 else len(source)), False, "", ""
            if name := _NAME.match(source, at):
                end = self.end_of_tag(name.end())
                return at, end + 1, sign == "/", name[1].lower(), source[name.end() : end]
            at += 1
        return None

    def end_of_tag(self, at: int) -> int:
        begin, opened = at, []
        while m := _SIGN.search(self.source, at):
            at = m.start()
            if m[0] == ">":
                return at
            opened.append(at)
            if at in self.lost or (at := self.source.find(m[0], at + 1)) < 0:
                break
            at += 1
        self.lost.update(opened)
        return self.source.find(">", begin)


def parse(source: str) -> Page:
    """The page's nodes and blocks, in time linear in its length: nothing searches the open elements."""
    page, scanner, buffer = Page(), Scanner(source), []
    stack: list[tuple[str, int]] = [("#", 0)]
    #: Places on the stack: of each tag, of elements that are nodes, of SCOPE, and of SCOPE and paragraphs.
    where: dict[str, list[int]] = {}
    nodes, scopes, ends_p = [0], [0], [0]
    links = linked = dropped = at = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                page.node.append(stack[nodes[-1]][1])
                page.text.append(text)
                page.linked.append(min(linked, len(text)))
            buffer.clear()
        linked = 0

    def last(tag: str) -> int:
        return where[tag][-1] if where.get(tag) else 0

    def open_(tag: str, node: int) -> None:
        nonlocal links, dropped
        k = len(stack)
        stack.append((tag, node))
        where.setdefault(tag, []).append(k)
        if node >= 0:
            nodes.append(k)
        if tag in SCOPE:
            scopes.append(k)
        if tag in SCOPE or tag == "p":
            ends_p.append(k)
        links += tag == "a"
        dropped += tag in DROPPED

    def close(depth: int) -> None:
        nonlocal links, dropped
        while len(stack) > depth:
            tag, node = stack[-1]
            if node >= 0:
                flush()
                nodes.pop()
            if tag in SCOPE:
                scopes.pop()
            if tag in SCOPE or tag == "p":
                ends_p.pop()
            where[tag].pop()
            stack.pop()
            links -= tag == "a"
            dropped -= tag in DROPPED

    def end_head() -> None:
        """What cannot stand in a head ends an open one."""
        depth = where["head"][0] if where.get("head") else 0
        if depth and (depth == len(stack) - 1 or dropped == 1):
            close(depth)

    while at < len(source):
        found = scanner.next(at)
        piece = source[at : found[0]] if found else source[at:]
        if dropped and piece and not piece.isspace() and stack[-1][0] == "head":
            end_head()
        if piece and not dropped:
            buffer.append(piece)
            if links:
                linked += len(piece.strip())
        if not found:
            break
        _, at, ends, tag, attrs = found
        if not tag:
            continue
        if ends:
            depth = last(tag)
            if depth and (tag in BLOCK or nodes[-1] < depth):
                close(depth)
            elif tag in BLOCK:
                flush()
            continue
        if dropped and tag not in HEAD:
            end_head()
        if tag in VOID:
            if tag == "hr":
                flush()
            elif not dropped:
                buffer.append(" " if tag == "br" else "")
            continue
        if tag in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(source, at)
            at = end.start() if end else len(source)
            if end:
                at = source.find(">", end.start()) + 1 or len(source)
            continue
        if tag in BLOCK:
            if stack[ends_p[-1]][0] == "p":  # a block ends an open paragraph
                close(ends_p[-1])
            if also := CLOSES.get(tag):
                over = max(last(t) for t in also)
                if over > scopes[-1]:
                    close(over)
            flush()
            page.tag.append(tag)
            page.parent.append(stack[nodes[-1]][1])
            page.attrs.append(attrs)
            open_(tag, len(page.tag) - 1)
        elif not attrs.rstrip().endswith("/") or tag == "a":
            if tag == "a" and links and nodes[-1] < last("a"):
                close(last("a"))
            open_(tag, -1)
    close(1)
    flush()
    return page


NAMES = (
    *(f"tag{k}" for k in range(len(GROUPS))),
    *(f"own{k}" for k in range(len(TOKENS))),
    *(f"above{k}" for k in range(1, len(TOKENS))),
    *("above_main", "above_tag_bad", "depth", "text", "links", "commas", "blocks", "long", "children", "siblings", "place", "share", "position", "rest", "hidden", "nodes"),
)


_GROUP = {tag: k for k, group in enumerate(GROUPS) for tag in group}
#: The groups of furniture: nav, header, footer, aside, form.
BAD = range(5, 10)


@lru_cache(4096)
def _told(attrs: str) -> int:
    """A bit for each list of TOKENS of which an attribute names a word; the last tells that the element is hidden."""
    words = {w.lower() for _, value in _ATTRIBUTE.findall(attrs) for w in _WORD.findall(value)}
    return sum((not words.isdisjoint(group)) << k for k, group in enumerate(TOKENS)) | (_HIDDEN.search(attrs) is not None) << len(TOKENS)


def _bits(masks: list[int], n: int) -> np.ndarray:
    return (np.array(masks, np.int64)[:, None] >> np.arange(n) & 1).astype(np.float32)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row per node, parents by row, depths), all pages one after the other.

    Nodes stand in page order, parents first, so one pass forward hands down what ancestors tell and one pass backward
    sums subtrees up, whatever the depth.
    """
    base = np.concatenate(([0], np.cumsum([len(p.tag) for p in pages]))).astype(np.int64)
    n = int(base[-1])
    parent = np.concatenate([np.array(p.parent, np.int64) + np.where(np.array(p.parent) < 0, 0, b) for p, b in zip(pages, base, strict=False)])
    page_of = np.repeat(np.arange(len(pages)), np.diff(base))
    first = base[:-1][page_of]
    tag = np.zeros((n, len(GROUPS)), np.float32)
    bad = len(TOKENS)  # the bit that tells a tag of furniture above
    depths, told, over = [0] * n, [0] * n, [0] * n
    sums = np.zeros((n, 5))  # characters, linked characters, commas and stops, blocks, long blocks
    starts, sizes, born = [math.inf] * n, [1] * n, [0] * n
    for p, b in zip(pages, base.tolist(), strict=False):
        for j in range(1, len(p.tag)):
            up = b + p.parent[j]
            depths[b + j] = depths[up] + 1
            over[b + j] = over[up] | told[up] & (1 << bad) - 1 | (_GROUP.get(p.tag[p.parent[j]], -1) in BAD) << bad
            if (g := _GROUP.get(p.tag[j], -1)) >= 0:
                tag[b + j, g] = 1
            if p.attrs[j]:
                told[b + j] = _told(p.attrs[j]) if len(p.attrs[j]) < 1000 else _told.__wrapped__(p.attrs[j])
        total = 0
        for node, text, linked in zip(p.node, p.text, p.linked, strict=True):
            sums[b + node] += (len(text), linked, text.count(",") + text.count(".") + text.count("。") + text.count("、"), 1, len(text) > 80)
            starts[b + node] = min(starts[b + node], total)
            total += len(text)
        for j in range(len(p.tag) - 1, 0, -1):
            up = b + p.parent[j]
            sizes[up] += sizes[b + j]
            born[up] += 1
            starts[up] = min(starts[up], starts[b + j])
    depth, start, size, children = np.array(depths, np.int64), np.array(starts), np.array(sizes, float), np.array(born, float)
    # A subtree is a run of nodes; all sums are whole numbers, so differences of running sums are exact.
    running = np.vstack((np.zeros((1, 5)), sums.cumsum(axis=0)))
    sums = running[np.arange(n) + size.astype(np.int64)] - running[:-1]
    own, above = _bits(told, len(TOKENS) + 1), _bits(over, len(TOKENS) + 1)
    up = np.where(parent < 0, np.arange(n), parent)
    order = np.argsort(up, kind="stable")
    place = np.empty(n)
    begin = np.flatnonzero(np.concatenate(([True], np.diff(up[order]) > 0)))
    place[order] = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    chars = np.maximum(sums[:, 0], 1)
    whole = np.maximum(sums[first, 0], 1)
    from_start = np.where(np.isfinite(start), start, 0) / whole
    rest = np.column_stack(
        (
            above[:, 0], above[:, -1], depth, np.log1p(sums[:, 0]), sums[:, 1] / chars, sums[:, 2] / chars * 100, np.log1p(sums[:, 3]), sums[:, 4] / np.maximum(sums[:, 3], 1),
            np.log1p(children), np.log1p(children[up]), place / np.maximum(children[up], 1), sums[:, 0] / np.maximum(sums[up, 0], 1), from_start, 1 - from_start - sums[:, 0] / whole, own[:, -1], np.log1p(size),
        )
    )
    return np.hstack((tag, own[:, :-1], above[:, 1:-1], rest)).astype(np.float32), parent, depth


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: for each tree and inner node the feature and threshold, and the values of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic gradient boosting with histogram splits."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)])
    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score = np.full(len(y), bias)
    inner, n = 2**DEPTH - 1, x.shape[1]
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows) > 20:
                cells = (binned[rows] + np.arange(n) * BINS).ravel()
                hg = np.bincount(cells, np.repeat(g[rows], n), n * BINS).reshape(n, BINS).cumsum(axis=1)
                hh = np.bincount(cells, np.repeat(h[rows], n), n * BINS).reshape(n, BINS).cumsum(axis=1)
                all_g, all_h = hg[0, -1], hh[0, -1]
                gain = hg**2 / (hh + 1) + (all_g - hg) ** 2 / (all_h - hh + 1) - all_g**2 / (all_h + 1)
                for k, e in enumerate(edges):
                    gain[k, len(e) :] = 0
                k, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[k, b] > best:
                    feature[t, node], cut[t, node] = k, edges[k][b]
            at[rows] = 2 * node + 1 + (x[rows, feature[t, node]] > cut[t, node])
        for k in range(inner + 1):
            rows = at == inner + k
            leaf[t, k] = RATE * g[rows].sum() / (h[rows].sum() + 1)
        score += leaf[t, at - inner]
    return Trees(feature, cut, leaf, bias)


def _words(rng: random.Random, low: int, high: int) -> str:
    out = ["".join(rng.choice("aeiourstnlmdcpbfgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
    return " ".join(w + rng.choice(["", "", "", "", "", "", ",", "."]) for w in out).capitalize() + "."


def framed(rng: random.Random, before: str, core: str, after: str) -> str:
    """A whole page, or one without html, head and body."""
    if (r := rng.random()) < 0.2:
        return before + core + after
    if r < 0.3:
        return f"<body>{before}{core}{after}</body>"
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 8)}</title><style>p{{}}</style></head><body>{before}{core}{after}</body></html>"


def synthetic_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page of random layout, its main text marked by MARK at the start of each block; its main blocks."""
    main: list[str] = []

    def mine(tag: str, low: int, high: int) -> str:
        text = _words(rng, low, high)
        main.append(text)
        if rng.random() < 0.1:
            cut = text.split(" ")
            k = rng.randrange(len(cut))
            cut[k] = f'<a href="/x">{cut[k]}</a>' if rng.random() < 0.5 else f"<b>{cut[k]}</b>"
            text = " ".join(cut)
        return f"<{tag}>{MARK}{text}" + (f"</{tag}>" if rng.random() < 0.9 else "")

    def attr(*names: str, bare: float = 0.12) -> str:
        if rng.random() < bare:
            return ""
        name = rng.choice(names)
        name = rng.choice([name, name, f"{name}-{rng.choice(['box', 'wrap', 'area', 'inner'])}", f"site-{name}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    links = lambda low, high: "".join(f'<li><a href="/{k}">{_words(rng, 1, 4)}</a></li>' for k in range(rng.randint(low, high)))
    par = lambda low, high, a=1, b=3: "".join(f"<p>{_words(rng, low, high)}</p>" for _ in range(rng.randint(a, b)))
    side = [
        lambda: f"<nav{attr('nav', 'menu', bare=0.5)}><ul>{links(2, 9)}</ul></nav>",
        lambda: f"<div{attr('menu', 'navbar', 'breadcrumb')}>" + rng.choice([f"<ul>{links(2, 8)}</ul>", " &gt; ".join(f'<a href="/">{_words(rng, 1, 2)}</a>' for _ in range(3))]) + "</div>",
        lambda: f"<header{attr('header', 'masthead', bare=0.5)}><div>{_words(rng, 1, 6)}</div><ul>{links(0, 5)}</ul></header>",
        lambda: f"<aside{attr('sidebar', 'related', 'widget', bare=0.5)}><h3>{_words(rng, 1, 3)}</h3>" + rng.choice([f"<ul>{links(2, 8)}</ul>", par(5, 40)]) + "</aside>",
        lambda: f'<div class="{rng.choice(["sidebar", "related", "widget", "trending"])}"><h4>{_words(rng, 1, 3)}</h4>' + rng.choice([f"<ul>{links(2, 8)}</ul>", par(5, 40)]) + "</div>",
        lambda: f'<div class="{rng.choice(["ad", "ads", "advert", "sponsored", "promo", "ad-slot"])}">' + rng.choice([_words(rng, 3, 40), par(3, 40)]) + "</div>",
        lambda: f'<div {rng.choice(["class", "id"])}="{rng.choice(["notice", "cookie-notice", "alert", "consent", "cookie-banner", "popup"])}">' + rng.choice([_words(rng, 5, 40), par(5, 40)]) + "</div>",
        lambda: f'<form action="/s"{attr("search", "login", "newsletter")}><label>{_words(rng, 1, 5)}</label><input name="q"><button>{_words(rng, 1, 1)}</button>{par(3, 20, 0, 1)}</form>',
        lambda: f'<div class="{rng.choice(["share", "social", "meta", "byline", "tags"])}">{_words(rng, 1, 8)}</div>',
    ]
    comments = lambda: f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "responses", "discussion", "reader-comments"])}"><h3>{_words(rng, 1, 3)}</h3>' + "".join(f'<div{attr("comment", "reply")}><p>{_words(rng, 3, 60)}</p></div>' for _ in range(rng.randint(1, 6))) + f"</{t}>"
    foot = lambda: bare() if rng.random() < 0.2 else rng.choice([f"<footer{attr('footer', 'legal', bare=0.6)}>{rng.choice([_words(rng, 3, 25), '&copy; ' + _words(rng, 1, 40), par(3, 25)])}{rng.choice(['', f'<ul>{links(1, 5)}</ul>'])}</footer>", f'<div class="{rng.choice(["footer", "bottom", "copyright"])}">&copy; {_words(rng, 3, 25)}</div>'])

    # Furniture that only its tag tells: no class, no link, few words or many.
    bare = lambda: (lambda t: f"<{t}>" + rng.choice([_words(rng, 1, 8), _words(rng, 1, 8), f"<p>{_words(rng, 1, 25)}</p>", f"<div>{_words(rng, 1, 10)}</div>", f"<ul><li>{_words(rng, 1, 2)}<li>{_words(rng, 1, 2)}</ul>", par(10, 60)]) + f"</{t}>")(rng.choice(["nav", "header", "footer", "aside", "form"]))
    side += [bare] * 4
    body = [mine(rng.choice(["h1", "h1", "h2"]), 1, 12)] if rng.random() < 0.9 else []
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8, 14, 25])):
        r = rng.random()
        if r < 0.75:
            body.append(mine("p", *rng.choice([(1, 4), (8, 40), (30, 120)])))
        elif r < 0.82:
            body.append(mine(rng.choice(["h2", "h3"]), 1, 7))
        elif r < 0.88:
            body.append("<ul>" + "".join(mine("li", 2, 25) for _ in range(rng.randint(1, 5))) + "</ul>")
        elif r < 0.92:
            body.append("<blockquote>" + mine("p", 5, 40) + "</blockquote>")
        elif r < 0.95:
            body.append("<table><tr>" + mine("td", 1, 6) + mine("td", 1, 6) + "</tr></table>")
        else:
            body.append(rng.choice(side[3:])())
    if rng.random() < 0.15:  # main text with many links
        body = [re.sub(r"(?<= )(\w{4,})(?= )", lambda m: f'<a href="/{m[1]}">{m[1]}</a>' if rng.random() < 0.3 else m[1], x) if x.startswith("<p>" + MARK) else x for x in body]
    if not main:
        body.append(mine("p", 2, 30))
    tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
    if rng.random() < 0.3:  # a small page with little furniture, which only tags tell
        before, core, after = "".join(bare() for _ in range(rng.choice([0, 1, 1, 2]))), "".join(body), "".join(bare() for _ in range(rng.choice([0, 1, 1, 2])))
        return framed(rng, before, f"<{tag}>{core}</{tag}>" if rng.random() < 0.5 else core, after), main
    names = attr("content", "post", "entry", "story", "article-body", "main") if rng.random() < 0.7 else ""
    inner = "".join(body)
    if rng.random() < 0.3:
        inner = f"<div{attr('text', 'entry', 'inner', 'x1')}>{inner}</div>"
    if rng.random() < 0.2:
        inner += comments()
    core = f"<{tag}{names}>{inner}</{tag}>" if rng.random() < 0.85 else inner
    if rng.random() < 0.4:
        core = f"<div{attr('page', 'wrapper', 'container', 'main')}>" + (rng.choice(side)() if rng.random() < 0.4 else "") + core + (rng.choice(side)() if rng.random() < 0.4 else "") + "</div>"
    before = "".join(rng.choice(side)() for _ in range(rng.choice([0, 1, 1, 2, 3])))
    after = "".join(rng.choice(side)() for _ in range(rng.choice([0, 0, 1, 2]))) + (comments() if rng.random() < 0.3 else "") + (foot() if rng.random() < 0.85 else "")
    return framed(rng, before, core, after), main


def labels(page: Page) -> np.ndarray:
    """1 for nodes that hold a marked block; the marks are taken off."""
    out = np.zeros(len(page.tag))
    for k, text in enumerate(page.text):
        if MARK in text:
            page.text[k] = text.replace(MARK, "")
            node = page.node[k]
            while node >= 0:
                out[node] = 1
                node = page.parent[node]
    return out


def trained(pages: int = TRAIN_PAGES, seed: int = 5) -> Trees:
    rng = random.Random(seed)
    own = [parse(synthetic_page(rng)[0]) for _ in range(pages)]
    y = np.concatenate([labels(p) for p in own])
    return fit(features(own)[0], y)


def decode(score: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The kept nodes: roots, and those whose best subtree is worth more than nothing, inside kept parents only."""
    gain, up, level = score.astype(float).tolist(), parent.tolist(), depth.tolist()
    kept = [True] * len(gain)
    for j in range(len(gain) - 1, -1, -1):  # children stand after their parents
        if level[j] and gain[j] > 0:
            gain[up[j]] += gain[j]
    for j, d in enumerate(level):
        kept[j] = not d or gain[j] > 0 and kept[up[j]]
    return np.array(kept, bool)


def extract(sources: list[str | None], model: Trees) -> list[str]:
    pages = [parse(s or "") for s in sources]
    if not pages:
        return []
    x, parent, depth = features(pages)
    kept = decode(model.score(x), parent, depth)
    out, base = [], 0
    for p in pages:
        out.append("\n".join(t for n, t in zip(p.node, p.text, strict=True) if kept[base + n]))
        base += len(p.tag)
    return out


def extract_pages(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    model = model or trained()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo : lo + 500]
                text = extract(part["html"].tolist(), model)
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return unmarked(marked(rows, "page_id").mapInPandas(each, "page_id long, url string, text string, n_chars long"), "page_id")
