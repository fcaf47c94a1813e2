"""Main text of web pages, by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, with scripts, styles and
other unseen elements gone and character references decoded. Each block has features of its
ancestors (tags, and the words of their class, id and role) and of its text (length, share of
links, punctuation, place in the page). A chain of two states, main text or not, is trained on
labelled pages by stochastic gradient steps on the conditional likelihood (forward-backward)
and decoded by Viterbi. The blocks decoded as main text are joined in page order.

The labelled pages are made here from a seed: invented prose in many layouts, each block labelled by
the part it was written for. `fit` takes any list of (html, main blocks), so real ones serve as well.

Defined results: null and empty html, and pages without blocks, have empty text. Repeated rows
are extracted each by itself. Unclosed and stray tags, cut-off pages and bad references are read
leniently; nothing is raised. A tag whose quote never closes ends at its first >. Time is in proportion to
the page, however deep its elements lie. Columns other than page_id, url and html are neither read nor returned.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, SEED, EPOCHS = 500, 11, 8

#: Elements by how text flows around them.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section main div body aside nav header footer form td th blockquote select".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)", re.S)
#: The rest of a tag, quoted values whole.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Blocks that open with a paragraph closed by the next one.
BREAKS_P = frozenset("p div ul ol dl table article section main aside nav header footer form h1 h2 h3 h4 h5 h6 blockquote pre hr figure fieldset address".split())


class Node:
    """An open element that text doesn't flow around, with the features that it adds to those of its ancestors."""

    __slots__ = ("name", "own", "new", "above", "depth", "score")

    def __init__(self, name: str, own: tuple, new: tuple, above: Node | None):
        self.name, self.own, self.new, self.above = name, own, new, above
        self.depth = above.depth + 1 if above else 1
        self.score: float | None = None


@dataclass
class Block:
    text: str
    within: Node | None
    linked: int


class Page:
    """The elements that are open at a place of a page; every step takes time in proportion to what it opens or closes."""

    def __init__(self):
        self.open: list[tuple[str, Node | None, int, int]] = []  # name, what it lies in or is, open SCOPES and open cells up to it
        self.at: dict[str, list[int]] = {}
        self.active: Counter = Counter()
        self.links = 0

    def node(self) -> Node | None:
        return self.open[-1][1] if self.open else None

    def scopes(self) -> int:
        return self.open[-1][2] if self.open else 0

    def cells(self) -> int:
        return self.open[-1][3] if self.open else 0

    def push(self, name: str, words: tuple) -> None:
        node = self.node()
        if name not in INLINE:
            own = (*(() if name in ("html", "body") else (f"in {name}",)), *(f"named {w}" for w in words))
            node = Node(name, own, tuple(f for f in own if not self.active[f]), node)
            self.active.update(own)
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, node, self.scopes() + (name in SCOPES), self.cells() + (name in ("td", "th"))))
        self.links += name == "a"

    def close_to(self, k: int) -> None:
        """Closes all elements from number k on."""
        while len(self.open) > k:
            name, node, *_ = self.open.pop()
            self.at[name].pop()
            self.links -= name == "a"
            if name not in INLINE:
                self.active.subtract(node.own)

    def last(self, *names: str) -> int:
        """Number of the innermost open element of these names, or -1."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def in_scope(self, k: int) -> bool:
        """Whether no element of SCOPES was opened within number k."""
        return self.scopes() == self.open[k][2]


def _tag_end(page: str, at: int) -> tuple[int, int]:
    """(end of the attributes, end of the tag) of a tag whose name ends at `at`."""
    end = REST.match(page, at).end()
    if page[end : end + 1] != ">":  # cut off, or a quote that never closes
        end = page.find(">", at)
        if end < 0:
            return len(page), len(page)
    return end, end + 1


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    parts: list[str] = []
    here = Page()
    linked = at = 0
    n = len(page)
    endless: set[str] = set()

    def flush():
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, here.node(), min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            parts.append(page[at:end])
            if here.links:
                linked += end - at
        if not m:
            break
        at = max(m.end(), at + 1)
        name = m[2]
        if not name:
            continue
        name = name.lower()
        stop, after = _tag_end(page, at)
        attributes, at = page[at:stop], after
        if m[1]:
            if name not in INLINE:
                flush()
            k = here.last(name)
            if k >= 0 and (name not in INLINE or here.in_scope(k)):
                here.close_to(k)
            continue
        closed = attributes.endswith("/")
        if name in UNSEEN:
            if name not in INLINE:
                flush()
            if not closed:
                found = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if found:
                    at = found.end()
                else:
                    endless.add(name)
                    at = n if name in ("script", "style", "title", "svg", "noscript", "template") else at
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            closes = CLOSES.get(name, ()) or (("p",) if name in BREAKS_P else ())
            while closes and (k := here.last(*closes)) >= 0 and _reaches(here, k, name):
                here.close_to(k)
                if name not in ("tr", "td", "th"):
                    break
        if name in VOID or closed:
            continue
        words: tuple = ()
        if "=" in attributes:
            words = tuple(sorted({p.lower() for g in NAMES.findall(attributes) for p in PART.findall("".join(g))}))
        here.push(name, words)
    flush()
    return out


def _reaches(here: Page, k: int, name: str) -> bool:
    """Whether a tag closes element number k by itself: nothing between them keeps it in, but that a row closes cells."""
    within = here.scopes() - here.open[k][2]
    cell = here.open[k][0] in ("td", "th")
    if name == "tr" and not cell:  # cells in between don't matter
        return within == here.cells() - here.open[k][3]
    return within == 0


def path_features(node: Node | None) -> list[str]:
    """Features of the elements that a block lies in."""
    out = [f"deep {min(node.depth if node else 0, 6)}"]
    if node:
        out.append(f"leaf {node.name}")
    while node:
        out += node.new
        node = node.above
    return sorted(out)


def path_score(node: Node | None, weight: dict) -> float:
    """The sum of their weights; what the elements add is kept with them."""
    if node is None:
        return weight.get("deep 0", 0.0)
    fresh = []
    at = node
    while at is not None and at.score is None:
        fresh.append(at)
        at = at.above
    for one in reversed(fresh):
        one.score = (one.above.score if one.above else 0.0) + sum(weight.get(f, 0.0) for f in one.new)
    return node.score + weight.get(f"leaf {node.name}", 0.0) + weight.get(f"deep {min(node.depth, 6)}", 0.0)


def text_features(b: Block, i: int, n: int) -> list[str]:
    size = b.text.count(" ") + 1
    last = b.text[-1]
    return [
        f"words {min(int(math.log2(size)), 7)}",
        f"linked {int(4 * b.linked / len(b.text))}",
        f"ends {'stop' if last in '.!?…' else 'alnum' if last.isalnum() else 'other'}",
        f"commas {min(b.text.count(','), 3)}",
        f"signs {any(c in b.text for c in '©|»·→')}",
        f"first {min(i, 3)}",
        f"last {min(n - 1 - i, 2)}",
    ]


@dataclass
class Chain:
    """Weights of features and steps, main text minus the rest; step[a, b] from state a to state b."""

    weight: dict = field(default_factory=dict)
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    opens: np.ndarray = field(default_factory=lambda: np.zeros(2))


def _log_sum(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log(math.exp(a - high) + math.exp(b - high))


def expected(emit: list[float], c: Chain) -> tuple[float, list[float], np.ndarray, np.ndarray]:
    """Forward-backward: (log of the sum over all paths, chance of main text at each block, expected steps, chances of the first state)."""
    n, s = len(emit), c.step
    ahead = [[c.opens[0], c.opens[1] + emit[0]]]
    for t in range(1, n):
        p = ahead[-1]
        ahead.append([_log_sum(p[0] + s[0, 0], p[1] + s[1, 0]), _log_sum(p[0] + s[0, 1], p[1] + s[1, 1]) + emit[t]])
    back = [[0.0, 0.0]]
    for t in range(n - 1, 0, -1):
        q = back[-1]
        back.append([_log_sum(s[0, 0] + q[0], s[0, 1] + emit[t] + q[1]), _log_sum(s[1, 0] + q[0], s[1, 1] + emit[t] + q[1])])
    back.reverse()
    z = _log_sum(*ahead[-1])
    main = [math.exp(ahead[t][1] + back[t][1] - z) for t in range(n)]
    steps = np.zeros((2, 2))
    for t in range(1, n):
        for a in (0, 1):
            for b in (0, 1):
                steps[a, b] += math.exp(ahead[t - 1][a] + s[a, b] + (emit[t] if b else 0.0) + back[t][b] - z)
    return z, main, steps, np.array([math.exp(ahead[0][k] + back[0][k] - z) for k in (0, 1)])


def fit(pages: list[tuple[str, set[str]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """Train on (html, texts of its main blocks) by stochastic gradient steps with AdaGrad rates."""
    data = []
    for page, main in pages:
        bs = blocks(page)
        if bs:
            data.append(([path_features(b.within) + text_features(b, i, len(bs)) for i, b in enumerate(bs)], [int(b.text in main) for b in bs]))
    c, seen = Chain(), {}
    step_seen, open_seen = np.full((2, 2), 1e-6), np.full(2, 1e-6)
    order = random.Random(SEED)
    for _ in range(epochs):
        order.shuffle(data)
        for rows, y in data:
            _, main, steps, opens = expected([sum(c.weight.get(f, 0.0) for f in row) for row in rows], c)
            for row, truth, chance in zip(rows, y, main):
                g = truth - chance
                if abs(g) > 1e-4:
                    for f in row:
                        seen[f] = seen.get(f, 1e-6) + g * g
                        w = c.weight.get(f, 0.0)
                        c.weight[f] = w + rate / math.sqrt(seen[f]) * (g - decay * w)
            g_step = -steps
            for a, b in zip(y, y[1:]):
                g_step[a, b] += 1
            g_open = np.array([y[0] == 0, y[0] == 1]) - opens
            step_seen += g_step**2
            open_seen += g_open**2
            c.step = c.step + rate / np.sqrt(step_seen) * (g_step - decay * c.step)
            c.opens = c.opens + rate / np.sqrt(open_seen) * (g_open - decay * c.opens)
    return c


def viterbi(emit: list[float], c: Chain) -> list[int]:
    """The likeliest states."""
    (s00, s01), (s10, s11) = c.step.tolist()
    a, b = c.opens[0], c.opens[1] + emit[0]
    came = []
    for e in emit[1:]:
        to0, to1 = (0 if a + s00 >= b + s10 else 1), (0 if a + s01 >= b + s11 else 1)
        came.append((to0, to1))
        a, b = (a + s00, b + s10)[to0], (a + s01, b + s11)[to1] + e
    state = int(b > a)
    out = [state]
    for pair in reversed(came):
        state = pair[state]
        out.append(state)
    return out[::-1]


def extractor(c: Chain):
    """Main text of one page."""

    def extract(page: str) -> str:
        bs = blocks(page)
        if not bs:
            return ""
        emit = [path_score(b.within, c.weight) + sum(c.weight.get(f, 0.0) for f in text_features(b, i, len(bs))) for i, b in enumerate(bs)]
        return "\n".join(b.text for b, y in zip(bs, viterbi(emit, c)) if y)

    return extract


def main_text(pages: DataFrame, chain: Chain) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(chain)  # some hundreds of weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = extractor(shared.value)
        for batch in batches:
            texts = [extract(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


# Labelled pages. Layouts vary in tags, names and order; each part knows whether it is main text.

_NAMES = {
    "main": (("article", ""), ("main", ""), ("div", "content"), ("div", "post-content"), ("section", "article-body"), ("div", "entry"), ("td", "content"), ("div", "story"), ("div", "")),
    "menu": (("nav", ""), ("ul", "menu"), ("div", "navbar"), ("div", "nav"), ("nav", "breadcrumb"), ("div", "top-links")),
    "header": (("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-header")),
    "footer": (("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright")),
    "side": (("aside", ""), ("div", "sidebar"), ("div", "related"), ("div", "widget"), ("section", "more-stories")),
    "advert": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsored"), ("section", "promo"), ("ins", "adsbygoogle")),
    "notice": (("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "consent"), ("div", "notice"), ("div", "newsletter"), ("div", "alert")),
    "form": (("form", ""), ("form", "search"), ("form", "subscribe"), ("form", "login")),
    "comments": (("div", "comments"), ("section", "comments"), ("ol", "commentlist"), ("div", "comment-thread"), ("div", "disqus")),
    "share": (("div", "share"), ("ul", "social"), ("div", "tags")),
}


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """n pages and the texts of their main blocks."""
    r = random.Random(seed)
    syllables = ["".join(r.choice("bcdfglmnprstvz") + r.choice("aeiouéä") + r.choice(("", "n", "r", "s")) for _ in range(1)) for _ in range(60)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    used: set[str] = set()

    def prose(lo: int, hi: int, stop: bool = True) -> str:
        while True:
            size = max(1, int(math.exp(r.uniform(math.log(lo), math.log(hi)))))
            words = [word() + ("," if r.random() < 0.08 else "." if r.random() < 0.06 else "") for _ in range(size)]
            text = " ".join(words).rstrip(",.")
            text = text[:1].upper() + text[1:] + ("." if stop else "")
            if text not in used:
                used.add(text)
                return text

    def element(kind: str, inner: str) -> str:
        tag, name = r.choice(_NAMES[kind])
        how = r.choice(("class", "id")) if name else ""
        extra = f' {how}="{name}{r.choice(("", "", "-1", " x"))}"' if name else ""
        return f"<table><tr><td{extra}>{inner}</td></tr></table>" if tag == "td" else f"<{tag}{extra}>{inner}</{tag}>"

    def links(k: int) -> str:
        one = lambda: f'<a href="/{word()}">{r.choice((word, lambda: prose(1, 3, False)))()}</a>'
        return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(k)) + "</ul>" if r.random() < 0.7 else "".join(f"<div>{one()}</div>" for _ in range(k))

    def boiler(kind: str) -> str:
        if kind in ("menu", "share"):
            return element(kind, links(r.randint(2, 9)))
        if kind == "header":
            return element(kind, f"<h1>{prose(1, 4, False)}</h1>" * (r.random() < 0.5) + f"<p>{prose(2, 9, False)}</p>" + links(r.randint(2, 6)) * (r.random() < 0.5))
        if kind == "footer":
            return element(kind, r.choice(("&copy; ", "© ", "", "")) + prose(2, 30, r.random() < 0.6) + r.choice(("", " &middot; " + prose(2, 12), f" | {prose(1, 3, False)}")))
        if kind == "side":
            return element(kind, f"<h3>{prose(1, 4, False)}</h3>" * (r.random() < 0.6) + (links(r.randint(2, 6)) if r.random() < 0.6 else f"<p>{prose(4, 40)}</p>"))
        if kind == "form":
            return element(kind, f"<label>{prose(1, 4, False)}</label><input name=x><button>{word()}</button>" + f"<p>{prose(4, 20)}</p>" * (r.random() < 0.4))
        if kind == "comments":
            return element(kind, f"<h3>{prose(1, 3, False)}</h3>" + "".join(f'<div class="comment"><span>{word()}</span><p>{prose(3, 60)}</p></div>' for _ in range(r.randint(1, 4))))
        return element(kind, prose(3, 40) if r.random() < 0.6 else f"<p>{prose(3, 40)}</p>")

    pages = []
    for _ in range(n):
        main: set[str] = set()

        def said(text: str, main=main) -> str:
            main.add(text)
            return text

        title = prose(2, 14, r.random() < 0.5)
        inner = [f"<h1>{said(title)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            text = prose(1 if r.random() < 0.2 else 6, 150)
            if kind < 0.68:
                inner.append(f"<p>{said(text)}</p>")
            elif kind < 0.8:
                inner.append(f"<p><b>{said(text)}<br>")
            elif kind < 0.86:
                inner.append(f"<h2>{said(prose(1, 8, False))}</h2>")
            elif kind < 0.9:
                inner.append("<ul>" + "".join(f"<li>{said(prose(2, 25, r.random() < 0.5))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.94:
                inner.append(f"<blockquote>{said(text)}</blockquote>")
            elif kind < 0.97:
                head, tail = text, prose(2, 20)
                inner.append(f'<p>{head} <a href="/{word()}">{tail}</a></p>')
                main.add(f"{head} {tail}")
            else:
                inner.append(boiler(r.choice(("advert", "share", "notice"))))
        if r.random() < 0.15:
            inner.append(boiler("comments"))
        body = element("main", "".join(inner))
        before = [boiler(k) for k in ("notice", "header", "menu", "advert", "form", "side") if r.random() < 0.45]
        after = [boiler(k) for k in ("side", "share", "form", "advert", "comments", "notice") if r.random() < 0.35]
        r.shuffle(before)
        r.shuffle(after)
        after += [boiler("footer")] * (r.random() < 0.9)
        wrapped = "".join([*before, body, *after])
        if r.random() < 0.4:
            wrapped = f'<div class="{r.choice(("wrapper", "page", "container", "site"))}">{wrapped}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{wrapped}</body></html>", main))
    return pages
