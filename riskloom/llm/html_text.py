"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree of binary variables, content or not. Each has a potential
of its own (tag, class and id words, share of link text) and shares one with its parent; one
sum-product pass from the leaves up and one back down give exact marginals. The text of blocks with a
marginal of one half or more is kept. Both kinds of potentials are learned from labelled pages that
``labelled_pages`` writes by rule.

Defined results: null or empty html, and pages without content, give an empty text; unclosed and
misnested elements are closed as browsers do for the common cases; blocks nested deeper than ``DEPTH``
are siblings there, as in browsers, and a page is read in time linear in its length however it is
nested; a character reference beyond Unicode is the replacement character; a tag that never ends is
dropped; a closed ``svg``, ``select`` or ``template`` is dropped with its content, an unclosed one
as a tag alone; formulas and the fallback of ``object`` are text; ``br`` is white space inside its block;
repeated pages are separate rows; an empty table gives no rows; a block at a marginal of exactly one half is
kept; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp svg title textarea select datalist".split())
#: Of these the rest of the page is the content where they are never closed; of the others only the tag is skipped then.
TO_THE_END = frozenset("script style iframe noembed noframes xmp title textarea".split())
MATH = frozenset("math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation".split())
INLINE = MATH | frozenset("object a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture audio video map".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
#: An open element of the key ends when one of its values starts.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"}}
HOLDS = frozenset("ul ol dl table tr tbody thead tfoot select menu".split())  # such an end stops the search upwards
#: Evidence of a block below this log-odds counts as none, so that many faint hints cannot outvote a clear one.
DEAD_ZONE = 0.7
_NEXT = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_REST = re.compile(r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*+>""")
_SVG = re.compile(r"<(/?)svg(?=[\s/>])", re.IGNORECASE)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
#: The label of a training page's element; pages that are not training pages have none, whatever they hold.
_TRUTH = re.compile(r"""\bdata-truth\s*=\s*["']?1""")
_LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")
#: Deepest nesting of blocks.
DEPTH = 512
#: What may end an open element when it starts, and which elements.
ENDED_BY = {tag: [open_ for open_, by in CLOSED_BY.items() if tag in by] for tag in set().union(*CLOSED_BY.values())}
#: Pages and characters of one forest.
PAGES, CHARACTERS = 256, 1 << 23
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Page:
    """Block elements in page order; ``runs`` are the pieces of text: block, text."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    truth: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    runs: list[list] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)

    def open(self, parent: int, tag: str, names: str, truth: int) -> int:
        if parent >= 0 and self.depth[parent] >= DEPTH:
            parent = self.parent[parent]
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.truth.append(truth)
        self.size.append(0)
        self.linked.append(0)
        return len(self.tag) - 1


def self_closed(attributes: str) -> bool:
    """Does a tag end in ``/>``, the slash being no part of an unquoted value?"""
    if not attributes.endswith("/"):
        return False
    begin = 1 + max(attributes.rfind(c) for c in " \t\n\r\f\"'")
    name, equals, value = attributes[begin:].partition("=")
    if equals:
        return len(value) < 2
    return len(name) < 2 or not attributes[:begin].rstrip().endswith("=")


def unescaped(text: str) -> str:
    """Character references decoded, those with more digits than any character has too."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0")
        return "\ufffd" if len(digits) > 7 else f"&#{'x' if m[2] else ''}{digits or 0};"

    return entities.unescape(_LONG_REFERENCE.sub(short, text))


def svg_ends(source: str) -> dict[int, int]:
    """Where each closed ``svg`` ends, by where its name ends; nested ones have ends of their own."""
    found: dict[int, int] = {}
    opened = []
    for m in _SVG.finditer(source):
        if not m[1]:
            rest = _REST.match(source, m.end())
            if not (rest and self_closed(source[m.end() : rest.end() - 1])):
                opened.append(m.end())
        elif opened:
            found[opened.pop()] = source.find(">", m.end()) + 1 or len(source)
    return found


def parse(source: str, marked: bool = False) -> Page:
    """Blocks and runs of text; labels are read from ``marked`` pages, the training ones, alone."""
    page = Page()
    top = page.open(-1, "#page", "", 0)
    stack: list[tuple[str, int]] = [("#page", top)]  # every open element with the block it lies in
    open_at: dict[str, list[int]] = {}  # where in the stack each tag is open
    blocks = [0]  # where in the stack an element is no inline one
    links = 0
    at, end = 0, len(source)
    fresh = True  # does the next text begin a run?
    svg: dict[int, int] | None = None
    never: set[str] = set()  # tags without an end from here on

    def text(a: int, b: int) -> None:
        nonlocal fresh
        if b <= a:
            return
        block = stack[-1][1]
        piece = source[a:b]
        if "&" in piece:
            piece = unescaped(piece)
        if fresh or not page.runs or page.runs[-1][0] != block:
            page.runs.append([block, []])
            fresh = False
        page.runs[-1][1].append(piece)
        n = len(piece) - piece.count(" ") if not piece.isspace() else 0
        page.size[block] += n
        page.linked[block] += n if links else 0

    def close_to(depth: int) -> None:
        nonlocal fresh, links
        while len(stack) > depth:
            tag, _ = stack.pop()
            open_at[tag].pop()
            if blocks[-1] == len(stack):
                blocks.pop()
            links -= tag == "a"
            fresh = fresh or tag not in INLINE

    def push(tag: str, block: int) -> None:
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append((tag, block))

    def innermost(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < end:
        m = _NEXT.search(source, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        if m[2] is None:
            stop = source.find("-->" if m[0] == "<!--" else ">", m.end())
            at = end if stop < 0 else stop + (3 if m[0] == "<!--" else 1)
            continue
        rest = _REST.match(source, m.end())
        stop = rest.end() if rest else source.find(">", m.end()) + 1
        if stop <= 0:
            break
        at, tag = stop, m[2].lower()
        if m[1]:
            if tag == "br":
                text_break(page, stack)
            depth = innermost((tag,))
            if depth and (tag not in INLINE or depth > blocks[-1]):
                close_to(depth)
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                text_break(page, stack)
            continue
        if tag in VOID:
            fresh = fresh or tag == "hr"
            continue
        if tag == "svg":
            svg = svg_ends(source) if svg is None else svg
            if not self_closed(source[m.end() : stop - 1]):
                at = svg.get(m.end(), at)
            continue
        if tag in MATH and self_closed(source[m.end() : stop - 1]):
            continue
        if tag in never:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            if not stop:
                if tag in TO_THE_END:
                    break
                never.add(tag)
                continue
            at = source.find(">", stop.end()) + 1 or end
            continue
        if tag in ENDS_P and stack[blocks[-1]][0] == "p":
            close_to(blocks[-1])
        for _ in range(3 if tag in ENDED_BY else 0):  # a row group ends a cell, its row and the group before
            depth = innermost(ENDED_BY[tag])
            if depth <= innermost(h for h in HOLDS if h not in ENDED_BY[tag]):
                break
            close_to(depth)
        if tag in INLINE:
            links += tag == "a"
            push(tag, stack[-1][1])
            continue
        if tag in ("html", "body") and any(t == tag for t, _ in stack[:4]):
            continue
        names, attributes = "", source[m.end() : stop - 1]
        if "=" in attributes:
            names = " ".join({k.lower(): v.strip("\"'") for k, v in _NAMES.findall(attributes)}.values())
        fresh = True
        push(tag, page.open(stack[-1][1], tag, names, int(marked and bool(_TRUTH.search(attributes)))))
    return page


def text_break(page: Page, stack: list[tuple[str, int]]) -> None:
    if page.runs and page.runs[-1][0] == stack[-1][1]:
        page.runs[-1][1].append(" ")


def static_features(tag: str, names: str) -> list[str]:
    words = {w.lower() for w in _WORDS.findall(names)}
    return ["bias", f"tag={tag}", *(f"word={w}" for w in sorted(words))]


def number_features(page: Page) -> np.ndarray:
    """Share of link text under each block, its own size, whether it has text of its own."""
    n = len(page.tag)
    size, linked = list(page.size), list(page.linked)
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        linked[page.parent[i]] += linked[i]
    total, own = np.array(size, float), np.array(page.size, float)
    density = np.array(linked, float) / np.maximum(total, 1)
    return np.stack([density, np.log1p(own) / 6, (own > 0).astype(float), np.log1p(total) / 10], 1)


@dataclass(frozen=True)
class Model:
    static: dict[str, float]
    numbers: tuple[float, ...]
    #: log potential of (parent, child) labels by tag of the child; "" for any other tag
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth; a parent stands before its children."""
    depth: list[int] = []
    for p in parent.tolist():
        depth.append(depth[p] + 1 if p >= 0 else 0)
    depth = np.array(depth, np.int64)
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def marginals(parent: np.ndarray, unary: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Content marginals of a forest. ``unary``: (n, 2) logs; ``edge``: (n, parent label, child label) logs."""
    by_depth = levels(parent)
    belief = unary.copy()  # own potential and what the children send up
    up = np.zeros_like(unary)
    for nodes in by_depth[:0:-1]:
        joint = edge[nodes] + belief[nodes][:, None, :]
        up[nodes] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
        np.add.at(belief, parent[nodes], up[nodes])
    for nodes in by_depth[1:]:
        cavity = belief[parent[nodes]] - up[nodes]  # the parent without this child's own message
        joint = edge[nodes] + cavity[:, :, None]
        belief[nodes] += np.logaddexp(joint[:, 0], joint[:, 1])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))


class Extractor:
    def __init__(self, model: Model):
        self.model = model
        self.static: dict[tuple[str, str], float] = {}
        self.numbers = np.array(model.numbers)
        self.edges = {t: np.array(e) for t, e in model.edge.items()}

    def _own(self, tag: str, names: str) -> float:
        key = (tag, names)
        if key not in self.static:
            if len(self.static) > 50_000:
                self.static.clear()
            self.static[key] = sum(self.model.static.get(f, 0.0) for f in static_features(tag, names))
        return self.static[key]

    def texts(self, sources: list[str]) -> list[str]:
        """Pages of a batch form one forest."""
        pages = [parse(s) for s in sources]
        first = np.cumsum([0, *(len(p.tag) for p in pages)])
        parent = np.concatenate([np.where(np.array(p.parent) >= 0, np.array(p.parent) + a, -1) for p, a in zip(pages, first, strict=False)])
        logit = np.concatenate([np.array(list(map(self._own, p.tag, p.names))) + number_features(p) @ self.numbers for p in pages])
        logit = np.sign(logit) * np.maximum(np.abs(logit) - DEAD_ZONE, 0)
        other = self.edges[""]
        edge = np.stack([self.edges.get(t, other) for p in pages for t in p.tag])
        keep = (marginals(parent, np.stack([np.zeros_like(logit), logit], 1), edge) >= 0.5).tolist()
        out = []
        for p, a in zip(pages, first.tolist(), strict=False):
            blocks = (" ".join("".join(pieces).split()) for block, pieces in p.runs if keep[a + block])
            out.append("\n".join(b for b in blocks if b))
        return out


def train(sources: list[str], rounds: int = 1000, rate: float = 2.0, shrink: float = 2e-4) -> Model:
    """Edges: smoothed share of labels given the parent's. Blocks: logistic regression on top of that.

    The edges are normalised and the regression is fitted given the parent, so a block without
    evidence of its own (see ``DEAD_ZONE``) sends no message up, however many such blocks there are.
    """
    pages = [parse(s, marked=True) for s in sources]
    index: dict[str, int] = {}
    rows, columns, labels, above, tags, numbers = [], [], [], [], [], []
    counts: dict[str, np.ndarray] = {"": np.full((2, 2), 0.5)}
    for p in pages:
        numbers.append(number_features(p))
        for i, (tag, names) in enumerate(zip(p.tag, p.names, strict=True)):
            for f in static_features(tag, names):
                rows.append(len(labels))
                columns.append(index.setdefault(f, len(index)))
            labels.append(p.truth[i])
            above.append(p.truth[p.parent[i]] if i else 0)
            tags.append(tag)
            for t in (tag, ""):
                counts.setdefault(t, np.full((2, 2), 0.5))[above[-1], labels[-1]] += i > 0
    edge = {tag: np.log(k / k.sum(1, keepdims=True)) for tag, k in counts.items()}
    given = np.array([edge[t][u, 1] - edge[t][u, 0] for t, u in zip(tags, above, strict=True)])
    r, c, y, x, n = np.array(rows), np.array(columns), np.array(labels, float), np.concatenate(numbers), len(labels)
    often = np.maximum(np.bincount(c, minlength=len(index)), 5)
    w, v = np.zeros(len(index)), np.zeros(x.shape[1])
    for _ in range(rounds):
        z = given + np.bincount(r, weights=w[c], minlength=n) + x @ v
        error = y - 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        w += rate * (np.bincount(c, weights=error[r], minlength=len(index)) / often - shrink * w)
        v += rate * (x.T @ error / n - shrink * v)
    return Model({f: float(w[i]) for f, i in index.items()}, tuple(v.tolist()), {t: tuple(map(tuple, e.tolist())) for t, e in edge.items()})


def labelled_pages(n: int = 500, seed: int = 11) -> list[str]:
    """Pages of varied layouts whose content blocks carry ``data-truth="1"``."""
    rng = random.Random(seed)
    pick = rng.choice
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(low: int, high: int) -> str:
        return " ".join("".join(pick(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def links(low: int, high: int) -> str:
        return "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(rng.randint(low, high)))

    def content() -> str:
        short = pick([0.1, 0.4, 0.9])
        out = [f"<{h} data-truth='1'>{words(2, 9)}</{h}>" for h in [pick(["h1", "h1", "h2"])] if rng.random() < 0.9]
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            long = (1, 4) if rng.random() < short else (8, 120)
            if kind < 0.7:
                out.append(f"<p data-truth='1'>{words(*long)}{pick(['', ' <a href=z>' + words(1, 4) + '</a> ' + words(0, 9)])}.</p>")
            elif kind < 0.78:
                out.append(f"<h2 data-truth='1'>{words(1, 6)}</h2>")
            elif kind < 0.84:
                out.append(f"<blockquote data-truth='1'>{pick(['', '<p data-truth=1>'])}{words(*long)}</blockquote>")
            elif kind < 0.9:
                out.append(f"<{(l := pick(['ul', 'ol']))} data-truth='1'>" + "".join(f"<li data-truth='1'>{words(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + f"</{l}>")
            elif kind < 0.94:
                out.append(f"<table data-truth='1'><tbody data-truth='1'><tr data-truth='1'><td data-truth='1'>{words(1, 4)}</td><th data-truth='1'>{words(1, 4)}</th></tr></tbody></table>")
            elif kind < 0.97:
                out.append(f"<pre data-truth='1'>{words(2, 30)}</pre>")
            else:
                out.append(f"<figure data-truth='1'><figcaption data-truth='1'>{words(2, 12)}</figcaption></figure>")
            if rng.random() < 0.12:
                out.append(noise())
        return "".join(out)

    def noise() -> str:
        inner = pick([lambda: f"<p>{words(1, 30)}</p>", lambda: words(1, 25), lambda: f"<ul>{links(1, 6)}</ul>", lambda: f"<h3>{words(1, 3)}</h3><p>{words(3, 25)}</p>", lambda: f"<div>{words(2, 20)}</div>"])()
        name = pick(["ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "sidebar", "side", "widget", "cookie", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "social", "share", "related", "comments", "comment", "comment-list", "replies", "breadcrumb", "breadcrumbs", "menu", "navbar", "navigation", "nav", "footer", "header", "copyright", "login", "search", "pagination", "disclaimer", "consent", "gdpr", "toolbar", "top-bar", "masthead", "tags", "skip"])
        tag = pick(["div", "div", "section", "aside", "p", "ul"])
        if tag == "ul":
            inner = links(2, 6)
        if tag == "p":
            inner = words(1, 20)
        return pick([
            f"<{tag} {pick(['class', 'id'])}='{name}'>{inner}</{tag}>",
            f"<nav>{pick([f'<ul>{links(2, 8)}</ul>', f'<a href=q>{words(1, 2)}</a>'])}</nav>",
            f"<aside>{inner if tag != 'ul' else words(3, 20)}</aside>",
            f"<form action=q><p>{words(1, 5)}</p><label>{words(1, 3)}</label><button>{words(1, 2)}</button></form>",
            f"<footer>{pick([words(3, 15), f'<p>{words(3, 20)}</p>'])}</footer>",
            f"<div class='comments'><h3>{words(1, 2)}</h3><div class='comment'><p>{words(3, 40)}</p></div></div>",
            f"<div role='navigation'><a href=q>{words(1, 2)}</a></div>",
            f"<dialog>{words(2, 10)}</dialog>",
        ])

    pages = []
    for _ in range(n):
        body = [f"<header>{pick([f'<h1>{words(1, 4)}</h1>', f'<p>{words(1, 5)}</p>', f'<nav><ul>{links(2, 8)}</ul></nav>'])}</header>"] if rng.random() < 0.6 else []
        body += [noise() for _ in range(rng.randint(0, 4))]
        frame = pick(["<article data-truth='1'>{}</article>", "<article data-truth='1'>{}</article>", "<main data-truth='1'><article data-truth='1'>{}</article></main>", "<main data-truth='1'>{}</main>", "<div class='content' data-truth='1'>{}</div>", "<div id='main' data-truth='1'><div class='post-body' data-truth='1'>{}</div></div>", "<div class='entry-content article' data-truth='1'>{}</div>", "<article data-truth='1'><div data-truth='1'>{}</div></article>", "<article data-truth='1'><section data-truth='1'>{}</section></article>", "<div class='story text' data-truth='1'>{}</div>"])
        body.append(frame.format(content()))
        body += [noise() for _ in range(rng.randint(0, 4))]
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body>{''.join(body)}</body></html>")
    return pages


_EXTRACTORS: dict[int, Extractor] = {}


def _forests(sources: list[str]):
    """Pages in runs of at most ``PAGES`` and about ``CHARACTERS``; a longer page is alone."""
    part, size = [], 0
    for s in sources:
        if part and (len(part) == PAGES or size + len(s) > CHARACTERS):
            yield part
            part, size = [], 0
        part.append(s)
        size += len(s)
    if part:
        yield part


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``; no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))  # features of the labelled pages

    def extract(batches):
        key = id(shared.value)
        if key not in _EXTRACTORS:
            _EXTRACTORS.clear()
            _EXTRACTORS[key] = Extractor(shared.value)
        own = _EXTRACTORS[key]
        for b in batches:
            sources = b.column("html").to_pylist()
            texts = [t for part in _forests(sources) for t in own.texts(part)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
