"""Question and answer rows from HTML tables and lists, with the standard library's parser."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: The title of a list item.
ITEM_TITLE = "Grievance Point"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


#: Decimal references of so many digits are beyond Unicode, whatever their length; they are read as the replacement character.
BEYOND = re.compile(r"&#0*[1-9][0-9]{7,};?")
ZEROS = re.compile(r"&#0{8,}(?=[0-9])")


def bounded_references(page: str) -> str:
    """The page without numeric character references that are too long to be read as numbers; the others keep their meaning."""
    return ZEROS.sub("&#", BEYOND.sub("\ufffd", page))


class _Tree(HTMLParser):
    """Elements in page order, each with the end of its subtree and the range of its pieces of text. A missing end tag ends with its parent; li, tr, td and th end with the next of
    their kind. Places of open elements are kept by tag, so that reading is linear however deep a page is."""

    ENDS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
    WITHIN = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.last: list[int] = []  # the element after its subtree
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.pieces: list[str] = []
        self._open: list[int] = []
        self._places: dict[str, list[int]] = {}  # depths of open elements
        self.feed(bounded_references(page))
        self.close()
        self._end(0)

    def _end(self, depth: int) -> None:
        for n in self._open[depth:]:
            self.last[n], self.ends[n] = len(self.tags), len(self.pieces)
            self._places[self.tags[n]].pop()
        del self._open[depth:]

    def _depth(self, tags: tuple[str, ...]) -> int:
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        depth = self._depth(self.ENDS.get(tag, ()))
        if depth > self._depth(self.WITHIN.get(tag, ())):
            self._end(depth)
        n = len(self.tags)
        self.tags.append(tag)
        self.last.append(n + 1)
        self.starts.append(len(self.pieces))
        self.ends.append(len(self.pieces))
        if tag not in VOID:
            self._places.setdefault(tag, []).append(len(self._open))
            self._open.append(n)

    def handle_endtag(self, tag):
        if self._places.get(tag):
            self._end(self._places[tag][-1])

    def handle_data(self, data):
        if piece := data.strip():
            self.pieces.append(piece)

    def text(self, n: int) -> str:
        """The pieces of text below an element, with one space between."""
        return " ".join(self.pieces[self.starts[n] : self.ends[n]])

    def under(self, tag: str, within: str, once: bool) -> Iterator[int]:
        """Elements of a tag below each one of another tag, in page order of the outer ones, then of the inner ones; once: not again for outer ones within outer ones."""
        inner, until = [n for n, t in enumerate(self.tags) if t == tag], 0
        for n, t in enumerate(self.tags):
            if t == within and not (once and n < until):
                until = self.last[n]
                yield from inner[bisect.bisect_right(inner, n) : bisect.bisect_left(inner, until)]


def entries(page: str | None, lists: bool, once: bool = False) -> Iterator[tuple[str, int, str, str]]:
    """(kind, ordinal, title, content): table rows of two cells and more with both texts, then, if asked, list items of ul lists; ordinals go on. A row or item within several
    tables or lists comes with each of them, or once; its text is all that it holds. What is read is linear in the page; nested lists give more rows than they have items, unless once."""
    t, n = _Tree(page or ""), 0
    cells = [c for c, tag in enumerate(t.tags) if tag == "td"]
    for row in t.under("tr", "table", once):
        k = bisect.bisect_right(cells, row)
        if k + 1 < len(cells) and cells[k + 1] < t.last[row]:
            title, content = t.text(cells[k]), t.text(cells[k + 1])
            if title and content:
                yield "row", n, title, content
                n += 1
    if lists:
        for item in t.under("li", "ul", once):
            if said := t.text(item):
                yield "item", n, ITEM_TITLE, said
                n += 1


def extract(pages: DataFrame, lists: bool = True, once: bool = False) -> DataFrame:
    """(page_id, kind, ord, title, content) of every page, written out every few rows."""
    names, types = ["page_id", "kind", "ord", "title", "content"], [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, types, strict=True)], names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for i, h in zip(b.column("page_id"), b.column("html"), strict=True):
                for e in entries(h.as_py(), lists, once):
                    out.append((i.as_py(), *e))
                    held += len(e[2]) + len(e[3]) + 64
                    if held > 1 << 20:
                        yield made(out)
                        out, held = [], 0
            yield made(out)

    return pages.select("page_id", "html").mapInArrow(of, "page_id long, kind string, ord int, title string, content string")
