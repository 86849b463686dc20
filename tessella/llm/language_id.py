"""Language identification by rank-order profiles of character n-grams.

A profile lists the PROFILE most frequent n-grams (n = 1 to 3) of a language's texts, or of a text, by rank. A text
gets the language with the smallest out-of-place distance: the sum, over the text's n-grams, of the difference of the
two ranks, or PROFILE where the language lacks the n-gram. Texts are lower-cased; every run of characters that are no
letters counts as one space.

Counts are exact over all training texts: tasks add up n-grams by language and batch, the engine sums them by
(language, n-gram) and keeps each language's first PROFILE. Only the profiles, PROFILE n-grams a language, reach the
driver.

Defined results: a null text or one without letters is `und` with score 0. Ties between n-grams go by code point,
ties between languages by name. Rows with null language are predicted, not learned from. Without training rows all
texts are `und`. The whole of every text is used.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 300
UNKNOWN = "und"
Profiles = dict[str, np.ndarray]  # by language: n-gram codes by rank


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """The codes of a text's n-grams, 21 bits a character; empty if it has no letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    ok = _letters()[c]
    if not ok.any():
        return np.empty(0, np.int64)
    c = np.where(ok, c, 32)
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # of a run of spaces, the first
    c = np.concatenate(([32], c[keep], [32]) if ok[0] else (c[keep], [32]))
    two, three = c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    return np.concatenate((c[c != 32], two[two != (32 << 21 | 32)], three[(three & 0x3FFFFFFFFFF) != (32 << 21 | 32)]))


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[at], np.diff(np.append(at, len(g)))


def ranked(g: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, by falling count, then code."""
    codes, n = counted(g)
    return codes[np.argsort(-n, kind="stable")[:size]]


#: N-grams held before they are counted: bounds a task's memory, whatever the batches.
HELD = 1 << 20


class _Counts:
    """Counts of one language, from n-grams that come in pieces."""

    def __init__(self) -> None:
        self.codes, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, g: np.ndarray) -> None:
        self.waiting.append(g)
        self.held += len(g)
        if self.held > HELD:
            self.settle()

    def settle(self) -> None:
        if self.held:
            codes, n = counted(np.concatenate(self.waiting))
            codes, n = np.concatenate((self.codes, codes)), np.concatenate((self.n, n))
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            self.codes, self.n = codes[at], np.add.reduceat(n, at)
        self.waiting, self.held = [], 0


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, _Counts] = {}
            for t, l in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                by.setdefault(l, _Counts()).add(grams(t.as_py() or ""))
            for l, c in by.items():
                c.settle()
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(c.codes), pa.string()), pa.array(c.codes), pa.array(c.n)], names=["lang", "gram", "n"])

    rows = docs.where(docs[lang].isNotNull()).select(docs[text].alias("text"), docs[lang].alias("lang")).mapInArrow(of, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(docs, text, lang).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in top.collect():
        out.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {l: np.array([g for _, g in sorted(v)], np.int64) for l, v in sorted(out.items())}


class Classifier:
    def __init__(self, profiles: Profiles, size: int = PROFILE):
        self.size, self.names = size, sorted(profiles)
        order = [np.argsort(profiles[l]) for l in self.names]
        self.tables = [(profiles[l][o], o) for l, o in zip(self.names, order, strict=True)]

    def __call__(self, text: str | None) -> tuple[str, float]:
        g = grams(text or "")
        if not len(g) or not self.names:
            return UNKNOWN, 0.0
        mine = ranked(g, self.size)
        ranks = np.arange(len(mine))
        best, name = None, UNKNOWN
        for l, (codes, rank) in zip(self.names, self.tables, strict=True):
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            d = int(np.where(codes[at] == mine, np.abs(rank[at] - ranks), self.size).sum())
            if best is None or d < best:
                best, name = d, l
        return name, 1.0 - best / (self.size * len(mine))


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = PROFILE) -> DataFrame:
    """The columns in keep, lang_pred and score (1 - distance / largest distance) of every row."""
    kept = docs.select(*keep)
    schema = kept.schema.add("lang_pred", "string").add("score", "double")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(profiles, size)
        for b in batches:
            out = [model(t.as_py()) for t in b.column("_text")]
            cols = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(of, schema)
