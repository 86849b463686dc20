"""Benchmark decontamination by template canonicalisation.

Texts become tokens: ASCII punctuation is dropped, A-Z is lower-cased, and numbers (words with a digit), names (words with
an upper-case first letter) and units (a fixed list, after a number) become typed placeholders. Windows of WINDOW tokens are
hashed, over whole texts, and hash-joined with the windows of the benchmark items. A join's windows on one diagonal
(the same shift between document and item) are an alignment; its slots, the placeholders' words on both sides, must be
consistent: one value of the item always stands for one value of the document. A consistent alignment that covers enough
of an item's windows is a leak: `verbatim` if all slots are equal, else `reparameterised`.

Template windows with fewer than MIN_LITERALS words that are no placeholders say nothing about an item and aren't used.

Case decides which words are names, so copies in another case share few template windows with their item, and items in
capitals or of names and numbers have none. Every item therefore also has literal windows: the case-folded words
themselves, without placeholders and without a minimum. Their alignments need the same cover, of the item's literal windows, and
are `verbatim`. Where both kinds align at one shift, the template windows judge. Of several shifts the one with most windows counts.

Items of equal text are one item, the one of the smallest id. An item with fewer tokens than a window is one window of its own size.

Windows of documents are made in Python on whole Arrow batches. If the items have at most FILTER_WINDOWS distinct
windows (counted), their hashes (8 bytes each) go to the tasks, which then only emit windows that will find a partner;
with more, all windows take part in the join. The result is the same.

Defined results: a null text is empty and has no windows. Repeated documents give repeated rows only if their ids differ;
rows are by (doc_id, item_id), so equal ids are one document whose texts are all searched. Empty tables give an empty
result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise

WINDOW = 8
MIN_LITERALS = 4
#: Share of an item's windows that an alignment must cover.
MIN_COVER = 0.2
FILTER_WINDOWS = 4_000_000
UNITS = (
    "mm cm m km inch inches ft feet yard yards mile miles g mg kg ton tons tonne tonnes lb lbs oz ml l liter liters litre litres s sec secs second seconds "
    "min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents euro euros "
    "pound pounds yen rupee rupees w kw mw v kv hz khz mhz ghz b kb mb gb tb kmh mph"
).split()

_SPACE, _DROP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DROP[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they have inverses modulo 2^64
NUM, NAME, UNIT = (np.uint64(x) for x in (11, 13, 17))
LITERAL = np.uint64(1 << 32)  # keeps hashes of literal windows apart from those of template windows


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTE = _mix((_LOWER + np.uint64(1)) * np.uint64(0x94D049BB133111EB))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(0, n - 1), base, np.uint64))))[:n]


class Tokens:
    """The tokens of some texts: hash, document number, and place of each in the kept bytes."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        keep = ~_DROP[data]
        self.data = data[keep]
        word = ~_SPACE[self.data]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(np.cumsum(keep)[ends - 1], self.start, side="right")
        n = len(self.start)
        if not n:
            self.hash, self.slot = np.empty(0, np.uint64), np.empty(0, bool)
            self.words = self.hash
            return
        total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[self.data] * _powers(_P, len(self.data)))))
        back = _powers(pow(_P, -1, 1 << 64), len(self.data))
        self.hash = _mix((total[self.stop] - total[self.start]) * back[self.start] + (self.stop - self.start).astype(np.uint64))
        self.words = self.hash
        digits = np.concatenate(([0], np.cumsum(_DIGIT[self.data])))
        number = digits[self.stop] > digits[self.start]
        first, second = self.data[self.start], self.data[np.minimum(self.start + 1, len(self.data) - 1)]
        name = ~number & ((first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        unit = np.concatenate(([False], number[:-1] & (self.doc[1:] == self.doc[:-1]))) & ~number & np.isin(self.hash, _unit_hashes())
        self.hash = np.select([number, unit, name], [NUM, UNIT, NAME], self.hash)
        self.slot = number | unit | name

    def windows(self, size: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every window, of placeholders or of words alone, and the number of its first token; windows don't cross documents."""
        tokens = self.words if literal else self.hash
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * np.uint64(_Q) + tokens[k : k + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return _mix(h[at] + np.uint64(size) + (LITERAL if literal else np.uint64(0))), at

    def slots(self, at: int, size: int) -> list[str]:
        return [self.data[self.start[k] : self.stop[k]].tobytes().decode("utf-8", "replace") for k in range(at, at + size) if self.slot[k]]


def folded(texts: list[bytes], tokens: Tokens) -> Tokens:
    """The tokens of the case-folded texts, number by number those of the texts; A-Z alone is folded in every hash already."""
    return tokens if all(t.isascii() for t in texts) else Tokens([t.decode().casefold().encode() for t in texts])


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        _units.append(np.empty(0, np.uint64))
        _units[0] = Tokens([" ".join(UNITS).encode()]).hash
    return _units[0]


HIT = "id long, at long, size int, literal boolean, hash long, slots array<string>"
_HIT = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("size", pa.int32()), ("literal", pa.bool_()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))])
#: Bytes of texts that are cut into tokens at once; tokens take about 48 bytes of memory a byte, twice over for texts that are case-folded.
CHUNK = 1 << 20


def _chunks(ids: list, texts: pa.Array) -> Iterator[tuple[list, list[bytes]]]:
    """Whole texts, CHUNK bytes or one text at a time."""
    some, held = ([], []), 0
    for i, t in zip(ids, texts, strict=True):
        b = (t.as_py() or "").encode()
        if held and held + len(b) > CHUNK:
            yield some
            some, held = ([], []), 0
        some[0].append(i)
        some[1].append(b)
        held += len(b)
    if some[0]:
        yield some


def doc_windows(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None, text: str, doc_id: str) -> DataFrame:
    """HIT of the windows of each of the sizes, or of those whose hash is wanted (sorted hashes)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _chunks(b.column("id").to_pylist(), b.column("text")):
                t, out = Tokens(texts), []
                f = folded(texts, t)
                first = np.searchsorted(t.doc, np.arange(len(texts)))
                for size, literal in itertools.product(sizes, (False, True)):
                    h, at = (f if literal else t).windows(size, literal)
                    h = h.view(np.int64)
                    if wanted is not None:
                        k = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
                        h, at = h[k], at[k]
                    d = t.doc[at]
                    out += [{"id": ids[x], "at": p - first[x], "size": size, "literal": literal, "hash": y, "slots": [] if literal else t.slots(p, size)} for x, p, y in zip(d.tolist(), at.tolist(), h.tolist(), strict=True)]
                for k in range(0, len(out), 20000):
                    yield pa.RecordBatch.from_pylist(out[k : k + 20000], schema=_HIT)

    return docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(of, HIT)


def item_windows(items: DataFrame, window: int, text: str, item_id: str) -> DataFrame:
    """HIT of every item's literal windows and of its template windows that have enough literal words, with the item's number of windows of
    the kind, n. Items of equal text are one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, s in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                texts = [(s.as_py() or "").encode()]
                t = Tokens(texts)
                size = min(window, len(t.hash))
                if not size:
                    continue
                h, at = t.windows(size)
                literal = np.concatenate(([0], np.cumsum(~t.slot)))
                use = np.flatnonzero(literal[at + size] - literal[at] >= min(MIN_LITERALS, size))
                out += [{"id": i, "at": int(at[k]), "size": size, "literal": False, "hash": int(h.view(np.int64)[k]), "slots": t.slots(at[k], size), "n": len(use)} for k in use]
                h, at = folded(texts, t).windows(size, True)
                out += [{"id": i, "at": a, "size": size, "literal": True, "hash": x, "slots": [], "n": len(at)} for a, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=_HIT.append(pa.field("n", pa.int64())))

    one = items.groupBy(items[text].alias("text")).agg(F.min(items[item_id].cast("long")).alias("id"))
    return one.select("id", "text").mapInArrow(of, HIT + ", n long")


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, min_cover: float = MIN_COVER, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", filter_windows: int = FILTER_WINDOWS) -> DataFrame:
    """(doc_id, item_id, verdict, n_windows, cover): the best alignment of each document with each item that it leaks."""
    bench = materialise(item_windows(items, window, item_text, item_id), "items")
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # at most `window` numbers
    hashes = bench.select("hash").distinct()
    n = hashes.count()
    wanted = None
    if n <= filter_windows:
        wanted = np.sort(np.array([r[0] for r in hashes.collect()], np.int64)) if n else np.zeros(1, np.int64)
    hits = doc_windows(docs, sizes, wanted, text, doc_id)
    it = bench.select(F.col("id").alias("item_id"), F.col("at").alias("i_at"), F.col("size").alias("i_size"), F.col("literal").alias("i_literal"), F.col("hash").alias("i_hash"), F.col("slots").alias("i_slots"), "n")
    met = hits.join(it, (F.col("hash") == F.col("i_hash")) & (F.col("size") == F.col("i_size")) & (F.col("literal") == F.col("i_literal")))
    # One alignment holds at most an item's windows, each with its slots: groups are bounded by the item's length.
    pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col("i_slots").alias("i"), F.col("slots").alias("d")))))
    lined = met.groupBy(F.col("id").alias("doc_id"), "item_id", (F.col("at") - F.col("i_at")).alias("shift"), "literal").agg(F.count_distinct("i_at").alias("n_windows"), F.max("n").alias("n"), pairs.alias("p"))
    values = F.transform("p", lambda x: x["i"])
    lined = lined.withColumn("cover", F.col("n_windows") / F.col("n")).where((F.size(F.array_distinct(values)) == F.size("p")) & (F.col("cover") >= min_cover))
    verdict = F.when(F.forall("p", lambda x: x["i"] == x["d"]), "verbatim").otherwise("reparameterised")
    best = lined.groupBy("doc_id", "item_id", "shift").agg(F.max(F.struct((~F.col("literal")).alias("template"), "n_windows", "cover", "p")).alias("x")).select("doc_id", "item_id", "x.*")
    best = best.select("doc_id", "item_id", F.struct("n_windows", verdict.alias("verdict"), "cover").alias("x")).groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "item_id", "x.verdict", "x.n_windows", "x.cover")
