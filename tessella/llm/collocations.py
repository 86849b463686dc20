"""Phrase collocations by contiguous pattern growth over projected occurrences.

Texts are lower-cased (A-Z), cut at `[.,;:!?` and line ends `]` into pieces, and those at blanks and tabs into words. A phrase's frequency is the number of its
contiguous occurrences within pieces, overlaps included, per language.

Words travel as 64-bit hashes of (seed, language, word); the words table shows whether two of its words share one, and then another seed is taken,
so counts are exact. Every occurrence of a prefix is projected to the words that follow it in its piece (at most `most_words - 1`); equal projections are summed
before they leave a task. Projections are dealt out by prefix, a prefix of very frequent words being split by the word that follows, and sorted, so
that the occurrences of any longer prefix are a range of pointers in its prefix's range. A task takes its prefixes one by one and grows each to the right, depth first,
as long as its range holds enough occurrences. It reads its projections as a stream and holds one prefix of two words at a time, of which the continuations that
are done are folded into one row when they are many.

A candidate has `least_words` to `most_words` words and a frequency a of at least `least`. Its score is the least, over its cuts in two, of
floor(1000000 * a * a / (l * r)), l and r being the frequencies of the parts; of equal scores the leftmost cut counts. Candidates that
lie contiguously in a longer candidate with at least `share` percent of their frequency are dropped. Numbers are decimals of 38 digits where
they are multiplied.

Defined results: a null text is empty; a null language is `und`. Repeated rows count as often as they stand. A piece of one word gives no phrase. Empty tables give an empty
result. Texts are read whole, whatever their length. Columns other than the two named aren't read and may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialise

ENDS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, LEAST_WORDS, MOST_WORDS, SHARE, TOP = 10, 2, 3, 50, 2000
#: Words with more than one in so many occurrences are hot: there are fewer of them than this. Prefixes of two hot words are split in SPLIT.
HOT, SPLIT = 256, 64
#: Tokens projected at a time, rows of an exchange's partition, and rows of a prefix of two words that are held before they are folded.
TOKENS, PART_ROWS, FOLD = 1 << 20, 2_000_000, 1 << 19


def _lower(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def _language(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("und"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, f)"""
    each = F.explode(F.split(_lower(docs[text]), f"(?:{ENDS}|{BLANKS})+"))
    return docs.select(_language(docs[lang]).alias("lang"), each.alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))


def hashed(seed: int, word: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("lang"), word)


def free_seed(words: DataFrame) -> int:
    """The first seed whose hashes tell all words apart, and from 0."""
    for seed in itertools.count():
        h = words.select(hashed(seed, F.col("word")).alias("h"))
        if h.groupBy("h").count().where("count > 1 OR h = 0").isEmpty():
            return seed


def projections(docs: DataFrame, seed: int, most_words: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(w0, w1, ..., n): every occurrence of a word that has one after it, with the following words of its piece (0: none); n equal ones."""
    ids = F.transform(F.split(F.col("t"), ENDS), lambda p: F.concat(F.transform(F.filter(F.split(p, BLANKS + "+"), lambda w: w != ""), lambda w: hashed(seed, w)), F.array(F.lit(0).cast("long"))))
    tokens = docs.select(_lower(docs[text]).alias("t"), _language(docs[lang]).alias("lang")).select(F.flatten(ids).alias("ids"))
    names = [f"w{k}" for k in range(most_words)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("ids").flatten().to_numpy()
            for a in range(0, len(flat), TOKENS):
                n = min(TOKENS, len(flat) - a)
                part = np.concatenate((flat[a : a + n + most_words - 1], np.zeros(most_words, np.int64)))
                words, rank = np.unique(part, return_inverse=True)
                start = np.flatnonzero((part[:n] != 0) & (part[1 : n + 1] != 0))
                goes_on, code, span = np.ones(len(start), bool), np.zeros(len(start), np.int64), 1
                none = int(np.searchsorted(words, 0))
                columns = []
                for k in range(most_words):
                    at = start + k
                    goes_on = goes_on & (part[at] != 0)
                    columns.append(np.where(goes_on, rank[at], none))
                    if span * len(words) >= 1 << 62:
                        code = np.unique(code, return_inverse=True)[1]
                        span = int(code.max(initial=0)) + 1
                    code, span = code * len(words) + columns[-1], span * len(words)
                _, first, count = np.unique(code, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(words[c[first]]) for c in columns), pa.array(count)], names=[*names, "n"])

    return tokens.mapInArrow(of, ", ".join(f"{c} long" for c in [*names, "n"]))


class Growth:
    """Grows prefixes to the right out of sorted projections that come in pieces: columns w0, w1, ... and n."""

    def __init__(self, most_words: int, least: int, hot: list[int]):
        self.most, self.least, self.hot = most_words, least, np.array(hot, np.int64)
        self.carry = np.empty((most_words + 1, 0), np.int64)
        self.found: list[tuple[np.ndarray, int]] = []

    def _runs(self, rows: np.ndarray, depth: int, lo: int, hi: int) -> np.ndarray:
        """The bounds of the ranges of pointers lo..hi that share word `depth`."""
        c = rows[depth, lo:hi]
        return np.concatenate(([lo], lo + 1 + np.flatnonzero(c[1:] != c[:-1]), [hi]))

    def grow(self, rows: np.ndarray, before: np.ndarray, depth: int, lo: int, hi: int) -> None:
        """The prefix of `depth` words with the pointers lo..hi, which is frequent, and all that extend it to the right."""
        path = np.zeros(self.most, np.int64)
        path[:depth] = rows[:depth, lo]
        self.found.append((path, int(before[hi] - before[lo])))
        if depth < self.most:
            self.extend(rows, before, depth, lo, hi)

    def extend(self, rows: np.ndarray, before: np.ndarray, depth: int, lo: int, hi: int) -> None:
        if before[hi] - before[lo] < self.least:
            return
        at = self._runs(rows, depth, lo, hi)
        n = before[at[1:]] - before[at[:-1]]
        for k in np.flatnonzero((n >= self.least) & (rows[depth, at[:-1]] != 0)).tolist():
            self.grow(rows, before, depth + 1, int(at[k]), int(at[k + 1]))

    def _prefixes(self, rows: np.ndarray, pairs: np.ndarray) -> None:
        """All prefixes of two words whose ranges lie between the bounds."""
        before = np.concatenate(([0], np.cumsum(rows[-1])))
        n = before[pairs[1:]] - before[pairs[:-1]]
        split = np.isin(rows[0, pairs[:-1]], self.hot) & np.isin(rows[1, pairs[:-1]], self.hot)
        for k in np.flatnonzero((n >= self.least) | split).tolist():  # of a split prefix another task may have the rest
            self.grow(rows, before, 2, int(pairs[k]), int(pairs[k + 1]))

    def add(self, rows: np.ndarray) -> None:
        rows = np.concatenate((self.carry, rows), axis=1)
        new = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        pairs = np.concatenate(([0], 1 + np.flatnonzero(new)))
        self._prefixes(rows[:, : pairs[-1]], pairs)
        self.carry = rows[:, pairs[-1] :]
        if self.carry.shape[1] > FOLD and self.most > 2:
            self._fold()

    def _fold(self) -> None:
        """Of the prefix at hand, continuations that have ended are grown and leave their number only."""
        c = self.carry
        last = int(self._runs(c, 2, 0, c.shape[1])[-2])
        if last > 1:
            self.extend(c, np.concatenate(([0], np.cumsum(c[-1]))), 2, 0, last)
            folded = np.zeros((self.most + 1, 1), np.int64)
            folded[:2, 0], folded[-1, 0] = c[:2, 0], c[-1, :last].sum()
            self.carry = np.concatenate((folded, c[:, last:]), axis=1)

    def end(self) -> None:
        if self.carry.shape[1]:
            self._prefixes(self.carry, np.array([0, self.carry.shape[1]]))

    def flush(self) -> pa.RecordBatch:
        paths = np.array([p for p, _ in self.found], np.int64).reshape(-1, self.most)
        made = pa.RecordBatch.from_arrays([*(pa.array(paths[:, k]) for k in range(self.most)), pa.array([n for _, n in self.found], pa.int64())], names=[*(f"w{k}" for k in range(self.most)), "f"])
        self.found = []
        return made


def frequent(docs: DataFrame, words: DataFrame, seed: int, least: int = LEAST, most_words: int = MOST_WORDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """(w0, w1, ..., f): the hashes of every phrase of 2 to most_words words with f >= least; 0 stands for no word."""
    spark, names = docs.sparkSession, [f"w{k}" for k in range(most_words)]
    total = words.agg(F.sum("f")).head()[0] or 0
    hot = [r[0] for r in words.where(F.col("f") * HOT > total).select(hashed(seed, F.col("word"))).collect()]  # fewer than HOT
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    among = lambda c: F.col(c).isin(hot) if hot else F.lit(False)
    follows = F.pmod(F.col(names[2]), F.lit(SPLIT)) if most_words > 2 else F.lit(0)
    salt = F.when(among("w0") & among("w1"), follows).otherwise(0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Growth(most_words, least, hot)
        for b in batches:
            if b.num_rows:
                g.add(np.stack([b.column(c).to_numpy() for c in [*names, "n"]]))
                yield g.flush()
        g.end()
        yield g.flush()

    dealt = projections(docs, seed, most_words, text, lang).repartition(parts, "w0", "w1", salt).sortWithinPartitions(*names)
    found = dealt.mapInArrow(of, ", ".join(f"{c} long" for c in [*names, "f"]))
    return found.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _part(words: Column, most_words: int) -> list[Column]:
    return [F.coalesce(F.get(words, k), F.lit(0)).cast("long") for k in range(most_words)]


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, least_words: int = LEAST_WORDS, most_words: int = MOST_WORDS, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that isn't dropped."""
    if not 2 <= least_words <= most_words:
        raise ValueError("phrases have two words at least")
    words = materialise(word_counts(docs, text, lang), "phrase-words")
    seed = free_seed(words)
    known = words.where(F.col("f") >= least).withColumn("h", hashed(seed, F.col("word")))
    names = [f"w{k}" for k in range(most_words)]
    phrases = materialise(frequent(docs, words, seed, least, most_words, text, lang), "phrases").withColumn("ids", F.filter(F.array(*names), lambda h: h != 0))
    size = F.size("ids")
    counts = phrases.select(*names, "f").unionByName(known.select(F.col("h").alias("w0"), *[F.lit(0).cast("long").alias(c) for c in names[1:]], "f"))

    def count_of(side: str) -> DataFrame:
        return counts.select(*[F.col(c).alias(f"{side}{k}") for k, c in enumerate(names)], F.col("f").alias(side))

    candidates = phrases.where(size >= least_words)
    cuts = candidates.select(*names, "ids", "f", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = {"l": F.slice("ids", F.lit(1), F.col("k")), "r": F.slice("ids", F.col("k") + 1, size - F.col("k"))}
    cuts = cuts.select(*names, "f", "k", *[c.alias(f"_{s}{i}") for s, p in parts.items() for i, c in enumerate(_part(p, most_words))])
    for s in "lr":
        one = count_of(s)
        cuts = cuts.join(one, [cuts[f"_{s}{k}"] == one[f"{s}{k}"] for k in range(most_words)]).select(*names, "f", "k", *[c for c in ("l", "r") if c in cuts.columns or c == s], *[c for c in cuts.columns if c.startswith("_")])
    exact = "cast({} AS decimal(19, 0))"
    score = F.expr(f"(cast(1000000 AS decimal(7, 0)) * ({exact.format('f')} * {exact.format('f')})) div ({exact.format('l')} * {exact.format('r')})")
    scored = cuts.withColumn("score", score).groupBy(*names, "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    within = [(k, n) for n in range(least_words, most_words) for k in range(most_words - n + 1)]
    inner = F.explode(F.array(*[F.when(size >= k + n, F.when(size > n, F.slice("ids", k + 1, n))) for k, n in within])).alias("inner") if within else None
    if within:
        most = candidates.select("f", inner).where("inner IS NOT NULL").select("f", *[c.alias(f"i{k}") for k, c in enumerate(_part(F.col("inner"), most_words))]).groupBy(*[f"i{k}" for k in range(most_words)]).agg(F.max("f").alias("longest"))
        scored = scored.join(most, [scored[c] == most[f"i{k}"] for k, c in enumerate(names)], "left").where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("f") * share))
    out = scored.select(*names, F.col("f").alias("a"), "best.l", "best.r", "best.score")
    for k, c in enumerate(names):
        word = known.select(F.col("h").alias("_h"), F.col("word").alias(f"_{k}"), *[F.col("lang")] * (k == 0))
        out = out.join(word, F.col(c) == F.col("_h"), "left" if k >= 2 else "inner").drop("_h")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n")).withColumnRenamed("lang", "_lang")
    return out.join(sizes, F.col("lang") == F.col("_lang")).select("lang", F.concat_ws(" ", *[f"_{k}" for k in range(most_words)]).alias("phrase"), "a", "l", "r", "n", "score")


def top(mined: DataFrame, first: int = TOP) -> DataFrame:
    """Each language's first phrases by score, frequency and bytes, with their rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
