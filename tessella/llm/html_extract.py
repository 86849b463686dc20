"""Main-text extraction by gradient-boosted trees over DOM nodes, with hierarchical decoding.

A page is read into a tree of block elements with text runs as leaves; inline elements only add to their run. Nodes
without text below them are dropped. Each node gets features: its kind, its attributes' tokens and those of its
ancestors, depth, place among and likeness to its siblings, and length, link and punctuation density of its subtree.
Boosted trees give the probability that a node holds main text. Decoding picks, for the whole tree, the most likely set of
nodes such that a node is kept only with its parent, and an element only with a child: no choice contradicts another.

The trees are trained here, on pages written by `labelled_pages` from a seed: TRAIN_PAGES is the bound of that sample. The
pages vary layouts, tag and attribute names, unclosed tags, and pages without telling names.

Defined results: null or empty html, or a page without text, gives an empty text. Unclosed elements end with the page;
unclosed scripts, styles, comments and tags hide the rest. Equal rows give equal results; a null id or url stays null. An empty table gives an
empty result. Other columns aren't carried and may have any name. Whole pages are read, one at a time, in time and memory linear in their
length: open elements are found by name, and features are made for at most ROWS nodes at a time.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.sources.html import bounded_references

TRAIN_PAGES = 1400
TREES, DEPTH, RATE, BINS, VOCABULARY = 80, 5, 0.3, 24, 150
#: Share of the nodes that each tree is fitted to.
SUBSAMPLE = 0.15

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math nobr object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style title textarea template iframe noframes noembed".split())
#: Elements whose own vocabulary, all but what HTML has too, is inline.
FOREIGN = frozenset("math svg".split())
#: What a start tag ends, if it is open and no barrier is in between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BARRIER = frozenset("ul ol dl table body html article section div main nav aside select".split())
GROUPS = {t: g for g, tags in enumerate(("#run", "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl", "nav menu", "header", "footer", "aside", "form button select option input label fieldset legend dialog", "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption details summary address", "body html")) for t in tags.split()}
#: A comment, a tag, or other markup; what isn't closed goes to the page's end, so that no place is read more than a few times.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TELLING = frozenset("class id role style itemprop hidden aria-label aria-hidden".split())


class Tree:
    """A page's nodes in page order: parent, end (the first node after the subtree), tag, tokens and text; text only for runs."""

    def __init__(self, page: str):
        self.parent, self.tag, self.tokens, self.end = [-1], ["body"], [()], [0]
        self.text: list[str | None] = [None]
        self.links = [0]  # characters of a run inside links
        self._open, self._parts, self._in_link, self._linked = [0], [], False, 0
        self._places: dict[str, list[int]] = {}  # places in _open by tag
        self._barriers: list[int] = []  # places of elements that are one
        self._read(page)
        self._run()
        for n in self._open:
            self.end[n] = len(self.tag)

    def _add(self, tag: str, tokens: tuple, text: str | None = None, links: int = 0) -> int:
        for column, value in ((self.parent, self._open[-1]), (self.tag, tag), (self.tokens, tokens), (self.text, text), (self.links, links), (self.end, len(self.tag) + 1)):
            column.append(value)
        return len(self.tag) - 1

    def _run(self) -> None:
        """Ends the run of text: white space becomes one space."""
        if self._parts:
            text = " ".join(html_lib.unescape(bounded_references("".join(self._parts))).split())
            if text:
                self._add("#run", (), text, min(self._linked, len(text)))
        self._parts, self._linked = [], 0

    def _close(self, depth: int) -> None:
        self._run()
        for n in self._open[depth:]:
            self.end[n] = len(self.tag)
            self._places[self.tag[n]].pop()
        del self._open[depth:]
        while self._barriers and self._barriers[-1] >= depth:
            self._barriers.pop()

    def _close_tags(self, tags: tuple, barred: bool) -> None:
        """Closes the innermost open element of one of the tags; barred: not one outside of a barrier."""
        depth = max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)
        if depth and not (barred and self._barriers and self._barriers[-1] > depth):
            self._close(depth)

    def _open_tag(self, tag: str, tokens: tuple) -> None:
        self._places.setdefault(tag, []).append(len(self._open))
        if tag in BARRIER:
            self._barriers.append(len(self._open))
        self._open.append(self._add(tag, tokens))

    def _text(self, s: str) -> None:
        if s:
            self._parts.append(s)
            if self._in_link:
                self._linked += len(s)

    def _read(self, page: str) -> None:
        at, size, foreign = 0, len(page), 0
        while at < size:
            m = TAG.search(page, at)
            if not m:
                self._text(page[at:])
                return
            self._text(page[at : m.start()])
            at = m.end()
            if not m[2] or page[at - 1] != ">":
                continue
            tag = m[2].lower()
            if tag in HIDDEN:
                if not m[1] and not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = end.end() if end else size
                continue
            if tag in FOREIGN and not m[3].endswith("/"):
                foreign = max(0, foreign - 1) if m[1] else foreign + 1
            if tag in INLINE or foreign and tag not in GROUPS:
                if tag == "a":
                    self._in_link = not m[1]
                elif tag == "br" or foreign and tag in ("text", "mtd"):
                    self._parts.append(" ")
                continue
            if m[1]:
                if tag not in ("body", "html", "head"):
                    self._close_tags((tag,), False)
                continue
            self._run()
            self._in_link = False
            if tag in ("html", "head", "body"):
                if tag == "body":
                    self.tokens[0] = self._attributes(m[3])
                continue
            self._close_tags(("p",), True)
            if tag in CLOSES:
                self._close_tags(CLOSES[tag], True)
            if tag not in VOID:
                self._open_tag(tag, self._attributes(m[3]))

    @staticmethod
    def _attributes(s: str) -> tuple:
        if "=" not in s and "hidden" not in s:
            return ()
        out = []
        for name, value in ATTRIBUTE.findall(s):
            if name.lower() in TELLING:
                out += [t.lower() for t in TOKEN.findall(value)] or [name.lower()]
        return tuple(dict.fromkeys(out))

    def pruned(self) -> Tree:
        """Without the nodes that have no text below them."""
        n = len(self.tag)
        runs = np.concatenate(([0], np.cumsum([t is not None for t in self.text])))
        end = np.array(self.end)
        keep = runs[end] > runs[np.arange(n)]
        if keep.all():
            return self
        place = np.concatenate(([0], np.cumsum(keep)))
        kept = np.flatnonzero(keep).tolist()
        for name in ("tag", "tokens", "text", "links"):
            old = getattr(self, name)
            setattr(self, name, [old[k] for k in kept])
        self.parent = [int(place[self.parent[k]]) if self.parent[k] >= 0 else -1 for k in kept]
        self.end = place[end[kept]].tolist()
        return self


NUMBERS = 27


def features(t: Tree, vocabulary: dict[str, int], rows: int) -> Iterator[np.ndarray]:
    """A row for each node, in pieces of at most `rows`: numbers, kind, ancestors' kinds, own tokens, ancestors' tokens."""
    n, v = len(t.tag), len(vocabulary)
    parent, end, me = np.array(t.parent), np.array(t.end), np.arange(n)
    length = np.array([len(s) if s else 0 for s in t.text], np.float64)
    tag = [GROUPS.get(k, 16) for k in t.tag]
    depth, order, siblings, same = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    children: list[list[int]] = [[] for _ in range(n)]
    # Kinds and tokens as bits of a number: own ones, and those of all ancestors.
    bits = {token: 1 << 16 + k for token, k in vocabulary.items()}
    own, above = [0] * n, [0] * n
    for k in range(n):
        own[k] = (1 << tag[k] if tag[k] < 16 else 0) | sum(bits.get(token, 0) for token in t.tokens[k])
        p = t.parent[k]
        if p >= 0:
            depth[k] = depth[p] + 1
            children[p].append(k)
            above[k] = above[p] | own[p]
    stop = lambda s: s.count(".") + s.count(",") + s.count("!") + s.count("?") + s.count(";")
    per_node = {
        "chars": length, "links": np.array(t.links, np.float64), "marks": np.array([stop(s) if s else 0 for s in t.text], np.float64), "runs": np.array([s is not None for s in t.text], np.float64),
        "items": np.array([g == 6 for g in tag], np.float64), "paragraphs": np.array([g == 4 for g in tag], np.float64), "forms": np.array([g == 12 for g in tag], np.float64),
    }
    total = {}
    for name, values in per_node.items():
        c = np.concatenate(([0.0], np.cumsum(values)))
        total[name] = c[end] - c[me]
    before, after, repeated = np.zeros(n), np.zeros(n), np.zeros(n)
    for kids in children:
        seen: dict[tuple, int] = {}
        for k in kids:
            seen[tag[k], t.tokens[k]] = seen.get((tag[k], t.tokens[k]), 0) + 1
        for i, k in enumerate(kids):
            order[k], siblings[k] = i, len(kids)
            repeated[k] = seen[tag[k], t.tokens[k]]
            same[k] = repeated[k] / len(kids)
            before[k] = total["chars"][kids[i - 1]] if i else 0
            after[k] = total["chars"][kids[i + 1]] if i + 1 < len(kids) else 0
    chars, tags = total["chars"], np.maximum(1, end - me - total["runs"])
    all_chars, of_parent = max(1.0, chars[0]), np.where(parent >= 0, chars[parent], chars)
    first = [next((s for s in t.text[k : k + 4] if s), "") for k in range(n)]
    numbers = [
        depth, order, siblings, same, repeated, order / np.maximum(1, siblings), end - me, np.log1p(chars), np.log1p(chars / tags), total["links"] / np.maximum(1, chars), total["marks"] / np.maximum(1, chars), np.log1p(total["marks"]),
        np.log1p(chars / np.maximum(1, total["runs"])), total["runs"], total["items"] / tags, total["paragraphs"] / tags, total["forms"], chars / all_chars, chars / np.maximum(1, of_parent), me / n, end / n, np.log1p(before), np.log1p(after),
        np.array(["©" in s or "copyright" in s.lower() for s in first], float), np.array([bool(s) and s[-1:] in ".!?" for s in first], float), (np.cumsum(length) - length) / all_chars, np.log1p([len(s) for s in first]),
    ]
    width = (16 + v + 7) // 8
    spread = lambda masks: np.unpackbits(np.frombuffer(b"".join(m.to_bytes(width, "little") for m in masks), np.uint8).reshape(-1, width), axis=1, bitorder="little")[:, : 16 + v]
    for at in range(0, n, rows):
        mine, over = spread(own[at : at + rows]), spread(above[at : at + rows])
        yield np.concatenate((np.stack([c[at : at + rows] for c in numbers], axis=1).astype(np.float32), mine[:, :16], over[:, :16], mine[:, 16:], over[:, 16:]), axis=1, dtype=np.float32)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss. The first columns are numbers, in histograms of quantile bins; the others are 0 or 1, and
    their histograms are a matrix product. Of the two children of a node only one is counted, the other is the rest."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, smoothing: float = 5.0, numbers: int = NUMBERS):
        self.trees, self.depth, self.rate, self.bins, self.smoothing, self.numbers = trees, depth, rate, bins, smoothing, numbers
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, threshold of the inner nodes; values of the leaves
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        numbers, bins = min(self.numbers, x.shape[1]), self.bins
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(numbers)]
        # All in bytes: a number's bin, or a flag. A split is (column, bin): a row is above it if its byte is larger.
        code = np.concatenate((np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8), (x[:, numbers:] > 0.5).astype(np.uint8)), axis=1)
        column = np.concatenate((np.repeat(np.arange(numbers), bins - 1), np.arange(numbers, x.shape[1])))
        bin_of = np.concatenate((np.tile(np.arange(bins - 1), numbers), np.zeros(x.shape[1] - numbers, np.int64)))
        usable = np.concatenate([np.arange(bins - 1) < len(e) for e in edges] + [np.ones(x.shape[1] - numbers, bool)])
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        scores, r, size = np.full(len(x), self.base), np.random.default_rng(0), max(1, int(len(x) * SUBSAMPLE))
        for _ in range(self.trees):
            some = np.sort(r.choice(len(x), size, replace=False))
            part = code[some]
            cells, flags = part[:, :numbers] + (np.arange(numbers) * bins)[None], part[:, numbers:].T.astype(np.float32)
            p = 1 / (1 + np.exp(-scores[some]))
            gh = np.stack((y[some] - p, p * (1 - p)), axis=1)
            where = np.zeros(size, np.int64)
            feature, above = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, 255)
            left = total = None  # of the last level: sums below each split, and of each node
            for level in range(self.depth):
                nodes = 2**level
                if not level:
                    left, total = self._below(cells, flags, gh, where, np.arange(size), 1)
                else:
                    below, sums = np.empty((nodes, *left.shape[1:])), np.empty((nodes, 2))
                    below[::2], sums[::2] = self._below(cells, flags, gh, where // 2, np.flatnonzero(where % 2 == 0), nodes // 2)
                    below[1::2], sums[1::2] = left - below[::2], total - sums[::2]
                    left, total = below, sums
                (gl, hl), (gt, ht) = (left[..., 0], left[..., 1]), (total[:, :1], total[:, 1:])
                gain = gl**2 / (hl + self.smoothing) + (gt - gl) ** 2 / (np.maximum(0, ht - hl) + self.smoothing) - gt**2 / (ht + self.smoothing)
                best = np.where(usable, gain, 0).argmax(axis=1)
                useful = np.where(usable, gain, 0)[np.arange(nodes), best] > 1e-6
                feature[nodes - 1 : 2 * nodes - 1] = np.where(useful, column[best], 0)
                above[nodes - 1 : 2 * nodes - 1] = np.where(useful, bin_of[best], 255)
                where = 2 * where + (part[np.arange(size), feature[nodes - 1 + where]] > above[nodes - 1 + where])
            leaves = 2**self.depth
            value = np.bincount(where, gh[:, 0], leaves) / (np.bincount(where, gh[:, 1], leaves) + self.smoothing) * self.rate
            threshold = np.array([np.inf if b == 255 else edges[f][b] if f < numbers else 0.5 for f, b in zip(feature, above, strict=True)])
            self.model.append((feature, threshold, value))
            scores += self._one(code, feature, above, value)
        return self

    def _below(self, cells: np.ndarray, flags: np.ndarray, gh: np.ndarray, where: np.ndarray, rows: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gh of the rows at or below every split, by node, and of all rows."""
        numbers, bins, at = cells.shape[1], self.bins, where[rows]
        total = np.stack([np.bincount(at, gh[rows, k], nodes) for k in (0, 1)], axis=1)
        index = (cells[rows] + (at * numbers * bins)[:, None]).ravel()
        sums = np.stack([np.bincount(index, np.repeat(gh[rows, k], numbers), nodes * numbers * bins) for k in (0, 1)], axis=-1).reshape(nodes, numbers, bins, 2)
        by_node = np.zeros((cells.shape[0], nodes, 2), np.float32)
        by_node[rows, at] = gh[rows]
        ones = (flags @ by_node.reshape(cells.shape[0], -1)).reshape(-1, nodes, 2).transpose(1, 0, 2)
        return np.concatenate((sums.cumsum(axis=2)[:, :, :-1].reshape(nodes, -1, 2), total[:, None] - ones), axis=1), total

    def _one(self, x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
        rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        return value[at - (2**self.depth - 1)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        return self.base + sum(self._one(x, *tree) for tree in self.model)


def decode(t: Tree, odds: np.ndarray) -> list[bool]:
    """The most likely labels under which a node is kept only with its parent and an element only with a child."""
    n = len(t.tag)
    yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    keep, drop = yes[:], no[:]  # best sums over the subtree, with the node kept or dropped
    bonus, loss, forced = [0.0] * n, [float("inf")] * n, [-1] * n  # an element's gain from its children; the least loss of keeping one
    parent = t.parent
    for k in range(n - 1, -1, -1):
        if t.text[k] is None:
            keep[k] += bonus[k] - (loss[k] if loss[k] > 0 else 0.0)
        p = parent[k]
        if p >= 0:
            drop[p] += drop[k]
            bonus[p] += max(keep[k], drop[k])
            cost = drop[k] - keep[k]
            if cost < loss[p]:
                loss[p], forced[p] = cost, k
    out = [False] * n
    out[0] = keep[0] > drop[0]
    for k in range(1, n):
        if out[parent[k]]:
            out[k] = keep[k] > drop[k] or forced[parent[k]] == k
    return out


#: Nodes whose features are held at once.
ROWS = 16384


class Extractor:
    def __init__(self, vocabulary: dict[str, int], trees: Boosted):
        self.vocabulary, self.trees = vocabulary, trees

    def __call__(self, pages: list[str | None]) -> list[str]:
        out: list[str] = []
        some: list[Tree] = []
        for p in pages:
            some.append(Tree(p or "").pruned())
            if sum(len(t.tag) for t in some) >= ROWS // 4:
                out += self._texts(some)
                some = []
        return out + self._texts(some)

    def _texts(self, trees: list[Tree]) -> list[str]:
        odds, waiting, held = [], [], 0
        for t in trees:
            for x in features(t, self.vocabulary, ROWS) if t.tag else ():
                waiting.append(x)
                held += len(x)
                if held >= ROWS:
                    odds.append(self.trees.predict(np.concatenate(waiting)))
                    waiting, held = [], 0
        if waiting:
            odds.append(self.trees.predict(np.concatenate(waiting)))
        every, out, at = np.concatenate(odds) if odds else np.empty(0), [], 0
        for t in trees:
            n = len(t.tag)
            kept = decode(t, every[at : at + n]) if n else []
            at += n
            out.append("\n".join(s for s, k in zip(t.text, kept, strict=True) if k and s is not None))
        return out


# --- labelled pages -----------------------------------------------------------------------------------------------

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu za an er in on st th nd ou re é ü ñ".split()
#: The running text that written pages take their words from: some are capitalised, some have marks behind them.
_r = random.Random(7)
_WORDS = [w.capitalize() if _r.random() < 0.04 else w for w in ("".join(_r.choices(_SYLLABLES, k=_r.randint(1, 4))) for _ in range(5000))]
_RUNNING = [a + b for a, b in zip(_r.choices(_WORDS, k=60_000), _r.choices(("", ",", ".", " &amp;&amp;&amp;", " ***", " $$$", " %%%", " |", " -", "***"), (0.83, 0.06, 0.08, 0.005, 0.005, 0.005, 0.005, 0.004, 0.004, 0.002), k=60_000), strict=True)]
_NAMES = {
    "menu": ("nav", "menu", "navbar", "topnav", "main-menu", "nav-links", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc"),
    "header": ("header", "site-header", "masthead", "banner", "top-bar", "branding", "logo", "page-header"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "page-footer", "foot"),
    "side": ("sidebar", "side", "widget", "widget-area", "right-col", "aside", "secondary", "rail", "related", "recommended", "popular", "trending", "tags", "author-box", "share", "social", "share-buttons", "sharing"),
    "notice": ("cookie", "cookie-banner", "consent", "gdpr", "notice", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "paywall", "promo", "disclaimer", "toast", "message", "banner-notice"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "sponsor", "promo-box", "banner-ad", "adsbox", "google-ad", "promoted", "commercial"),
    "form": ("form", "search", "search-form", "login", "signup", "contact-form", "comment-form", "poll"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "reply", "responses", "disqus", "feedback", "reader-comments", "user-comments"),
    "main": ("content", "main", "article", "post", "entry", "entry-content", "post-content", "article-body", "story", "story-body", "main-content", "text", "body-text", "post-body", "page-content", "richtext"),
    "wrap": ("wrapper", "container", "page", "site", "row", "col", "inner", "layout", "grid", "outer"),
}


class _Writer:
    """Writes a page and, beside it, which runs are main text: those written between the marks."""

    def __init__(self, r: random.Random):
        self.r, self.named = r, r.random() < 0.85
        self.main_texts: list[str] = []

    def words(self, n: int) -> str:
        at = self.r.randrange(len(_RUNNING) - n)
        w = _RUNNING[at : at + n]
        if self.r.random() < 0.05:  # junk: a word over and over, or one in every place
            w = w[:1] * n if self.r.random() < 0.5 else [x + " |" for x in w]
        return " ".join([w[0].capitalize(), *w[1:]])

    def sentence(self, lo: int, hi: int) -> str:
        return self.words(self.r.randint(lo, hi)) + self.r.choice((".", ".", ".", "", "!", "?"))

    def attributes(self, role: str, chance: float = 0.85) -> str:
        if not self.named or self.r.random() > chance:
            return ""
        name = self.r.choice(_NAMES[role])
        kind = self.r.choice(("class", "class", "class", "id"))
        extra = f" {self.r.choice(_NAMES['wrap'])}" if kind == "class" and self.r.random() < 0.15 else ""
        return f' {kind}="{name}{extra}"' + (' hidden' if role == "notice" and self.r.random() < 0.1 else "")

    def link(self) -> str:
        w = self.words(self.r.randint(1, 4)).rstrip(".,") + self.r.choice(("", "", "", "", "", ".", ",", "!"))
        w = w.lower() if self.r.random() < 0.4 else w
        return f'<a href="/{w.split()[0]}">{w}</a>'

    def menu(self) -> str:
        tag, items = self.r.choice(("nav", "nav", "div", "ul")), [self.link() for _ in range(self.r.randint(3, 9))]
        body = "".join(f"<li>{i}</li>" for i in items) if self.r.random() < 0.8 else None
        if tag == "ul":
            return f"<ul{self.attributes('menu')}>{''.join(f'<li>{i}' for i in items)}</ul>"
        return f"<{tag}{self.attributes('menu', 0.5 if tag == 'nav' else 0.95)}>{f'<ul>{body}</ul>' if body else ' | '.join(items)}</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "header", "div"))
        return f"<{tag}{self.attributes('header', 0.5 if tag == 'header' else 0.95)}><{(h := self.r.choice(('h1', 'p', 'div', 'h2')))}>{self.words(self.r.randint(1, 4))}</{h}>{self.r.choice(('', f'<p>{self.sentence(2, 8)}</p>'))}{self.menu() if self.r.random() < 0.4 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        text = self.r.choice((f"&copy; {self.words(2)} &middot; {self.sentence(3, 16)}", f"<p>&copy; 2024 {self.words(3)}</p><p>{self.sentence(4, 20)}</p>", f"{self.link()} {self.link()} <p>{self.sentence(3, 14)}</p>"))
        return f"<{tag}{self.attributes('footer', 0.4 if tag == 'footer' else 1)}>{text}</{tag}>"

    def side(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        inner = "".join(self.r.choice((f"<p>{self.sentence(3, 25)}</p>", f"<h3>{self.words(2)}</h3><ul>{''.join(f'<li>{self.link()}</li>' for _ in range(self.r.randint(2, 6)))}</ul>", self.ad())) for _ in range(self.r.randint(1, 3)))
        return f"<{tag}{self.attributes('side', 0.5 if tag == 'aside' else 1)}>{inner}</{tag}>"

    def notice(self) -> str:
        button = f"<button>{self.words(1)}</button>" if self.r.random() < 0.6 else ""
        return f"<{(t := self.r.choice(('div', 'div', 'section', 'dialog', *['p'] * self.named)))}{self.attributes('notice', 1)}>{self.sentence(4, 30) if t == 'p' or self.r.random() < 0.5 else f'<p>{self.sentence(4, 30)}</p>'}{button if t != 'p' else ''}</{t}>"

    def ad(self) -> str:
        text = self.sentence(2, 25)
        return f"<{(t := self.r.choice(('div', 'div', 'aside', 'section')))}{self.attributes('ad', 1)}>{self.r.choice((text, f'<p>{text}</p>', f'<p>{text}</p><p>{self.link()}</p>'))}</{t}>"

    def form(self) -> str:
        return f"<form{self.attributes('form', 0.6)}><label>{self.words(2)}</label><input name=q>{self.r.choice(('', f'<p>{self.sentence(3, 12)}</p>', f'<select><option>{self.words(1)}<option>{self.words(1)}</select>'))}<button>{self.words(1)}</button></form>"

    def comments(self) -> str:
        tag, item = self.r.choice((("section", "div"), ("div", "div"), ("ol", "li"), ("ul", "li"), ("div", "article")))
        one = lambda: f"<{item}{self.attributes('comments', 0.7)}>{self.r.choice((f'<b>{self.words(1)}</b> ', f'<h4>{self.words(2)}</h4>', f'<cite>{self.words(1)}</cite>'))}<p>{self.sentence(2, 60)}</p>{self.r.choice(('', self.link()))}</{item}>"
        title = f"<h3>{self.r.choice(('Comments', 'Kommentare', 'Commentaires', self.words(2)))}</h3>" if tag != "ol" and tag != "ul" else ""
        return f"<{tag}{self.attributes('comments', 1)}>{title}{''.join(one() for _ in range(self.r.randint(1, 6)))}{self.form() if self.r.random() < 0.3 and title else ''}</{tag}>"

    def main_text(self, lo: int, hi: int, inline: bool = True) -> str:
        text = self.sentence(lo, hi)
        self.main_texts.append(" ".join(html_lib.unescape(text).split()))
        if inline and self.r.random() < 0.4:
            w = text.split(" ")
            a = self.r.randrange(len(w))
            tag = self.r.choice(("b", "em", "i", "strong", "a href='#'"))
            w[a] = f"<{tag}>{w[a]}" + ("" if tag == "b" and self.r.random() < 0.5 else f"</{tag.split()[0]}>")
            text = " ".join(w)
        return text

    def block(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.72:
            lo, hi = r.choice(((1, 4), (3, 15), (15, 60), (40, 160)))
            return f"<p>{self.main_text(lo, hi)}{r.choice(('</p>', '</p>', '</p>', '<br>', ''))}"
        if kind < 0.8:
            return f"<{(h := r.choice(('h2', 'h3')))}>{self.main_text(1, 6)}</{h}>"
        if kind < 0.88:
            return f"<{(t := r.choice(('ul', 'ol')))}>{''.join(f'<li>{self.main_text(1, 20)}{r.choice(chr(32) + chr(10))}' for _ in range(r.randint(2, 6)))}</{t}>"
        if kind < 0.93:
            return f"<blockquote><p>{self.main_text(5, 40)}</p></blockquote>"
        if kind < 0.96:
            return f"<pre>{self.main_text(3, 20, False)}</pre>"
        if kind < 0.98:
            return f"<table><tr><td>{self.main_text(1, 5)}</td><td>{self.main_text(1, 5)}</td></tr></table>"
        return f"<figure><img src=x><figcaption>{self.main_text(2, 12)}</figcaption></figure>"

    def article(self) -> str:
        r = self.r
        body = [f"<h1>{self.main_text(2, 12)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
            body.append(self.block())
            if r.random() < 0.07:
                body.append(r.choice((self.ad, self.side, self.form, self.notice))())
        inner = "".join(body)
        if r.random() < 0.25:
            inner = f"<div{self.attributes('main', 0.7)}>{inner}</div>"
        if r.random() < 0.2:
            inner += r.choice((self.side, self.comments))()
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        inner = f"<{tag}{self.attributes('main', 0.4 if tag in ('article', 'main') else 1)}>{inner}</{tag}>"
        return f"<main>{inner}</main>" if tag == "article" and r.random() < 0.3 else inner

    def page(self) -> str:
        r = self.r
        ahead = [f() for f in (self.header, self.menu, self.notice, self.ad, self.side, self.form) if r.random() < (0.7 if f == self.menu else 0.35)]
        r.shuffle(ahead)
        after = [f() for f in (self.comments, self.side, self.ad, self.notice, self.form, self.menu) if r.random() < 0.35]
        r.shuffle(after)
        article = self.article()
        body = "".join(ahead) + article + "".join(after) + (self.footer() if r.random() < 0.85 else "")
        if r.random() < 0.35:
            body = f"<div{self.attributes('wrap', 0.8)}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{body}" + r.choice(("</body></html>", ""))


def labelled_pages(n: int = TRAIN_PAGES, seed: int = 1) -> list[tuple[str, str]]:
    """(html, main text) of n written pages."""
    out = []
    for k in range(n):
        w = _Writer(random.Random(seed * 1_000_003 + k))
        page = w.page()
        out.append((page, "\n".join(w.main_texts)))
    return out


def labels(t: Tree, text: str) -> np.ndarray:
    """Which nodes hold main text: runs by the page's text, in order, elements by their runs."""
    wanted, y = iter(text.split("\n") if text else []), np.zeros(len(t.tag))
    want = next(wanted, None)
    for k, s in enumerate(t.text):
        if s is not None and s == want:
            y[k], want = 1, next(wanted, None)
            p = t.parent[k]
            while p >= 0:
                y[p], p = 1, t.parent[p]
    return y


@functools.lru_cache(2)
def train(n: int = TRAIN_PAGES, seed: int = 1) -> Extractor:
    pages = labelled_pages(n, seed)
    trees = [Tree(p).pruned() for p, _ in pages]
    counts: dict[str, int] = {}
    for t in trees:
        for token in {x for k in t.tokens for x in k}:
            counts[token] = counts.get(token, 0) + 1
    vocabulary = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[:VOCABULARY])}
    x = np.concatenate([f for t in trees for f in features(t, vocabulary, ROWS)])
    y = np.concatenate([labels(t, text) for t, (_, text) in zip(trees, pages, strict=True)])
    return Extractor(vocabulary, Boosted().fit(x, y))


RESULT = "page_id long, url string, text string, n_chars long"
CHUNK = 32


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: Extractor | None = None) -> DataFrame:
    """RESULT of every row of pages."""
    model = model or train()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                text = model(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), pages[html].alias("html")).mapInArrow(of, RESULT)
