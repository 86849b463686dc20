"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits: bit b is 1 if over half of the hashes of a text's word shingles (repeats included) have it.
Fingerprints link at `radius` or fewer differing bits. Candidate pairs come from 2^(radius+1) - 1 tables: every bit
gets a vector of radius + 1 bits that isn't zero, and table v keeps the bits whose vector has an odd product with v. For any set of
at most radius differing bits some v is orthogonal to all their vectors, so that table keeps none of the differing
bits and the pair meets there: no link is lost, by construction.

Equal fingerprints are one node, with the smallest document id. A bucket of a few nodes is compared within itself. A
larger bucket isn't: its nodes go through the tables of another set of vectors, under the bits kept so far, where
again every link meets in some table; this repeats until buckets are small, or keep all but few bits, which bounds
the distinct nodes they can have. Buckets give the edges of a spanning forest of their links, not all pairs. A level is one
exchange of (path, fingerprint), from which the masked fingerprint follows, and one pass over sorted rows, which holds one bucket at most.
Components come from min-label contraction over these edges, each round written to the shared folder.

With a wide radius, unrelated fingerprints link by chance in a large corpus. `check_words` adds a check fingerprint, of
shingles of that many words, which is exchanged with the first; only what is also within `check_radius` bits by it is a link, and
forests span these links. A node's check fingerprint is that of its document of the smallest id.

`rounds` takes several independent fingerprints of the same shingles, each with tables of its own: documents link if one of them does.
The chance to miss a similar pair falls with every round, where a wider radius doubles the tables for each bit. All rounds go through
the levels together, the round being part of a bucket's key. Components then run over
the values of all rounds, joined by the documents that have them; values are told apart by 64-bit hashes of (round, value).

With `minwise_bits`, a bit is one of the shingles' smallest value under a hash of its own, MINWISE_BITS of them a round: two texts differ in it with a probability of half of one minus the Jaccard
similarity of their sets of shingles. At a five-word similarity of 0.8 majority bits differ in 8 to 10 of 64, which no radius of few tables covers; minwise ones differ in 4.8 of 48, so that several
rounds of radius 3, of 15 tables each, find nearly all such pairs. The check then has BITS further minwise bits. Texts of an equal value of a round are one node: they are alike but for a
chance of 0.85^48 at a similarity of 0.7.

Defined results: a text without words, null included, has fingerprint 0 and links like any other. A text of fewer
words than a shingle is one shingle. Texts of any length are read whole, 65535 shingles at a time. Equal rows are equal fingerprints. A null
id is larger than all others. An empty table gives an empty result. Other columns aren't carried and may have any name.
"""

from __future__ import annotations

import functools
import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise

SEED = 42
RADIUS = 3
WORDS = 3
BITS = 64
#: Buckets up to this many distinct fingerprints (8 bytes each) are compared within; larger ones go to the next set of tables. Comparing takes a
#: pass over what isn't linked yet for each node, few passes where nodes are close together, and gives edges of a forest only.
BUCKET = 1 << 15
#: Buckets with so few bits left free have at most BUCKET distinct fingerprints. More than the radius: a table may keep none of so few bits.
FREE = 15
#: A path's bits below this one are its tables; those above are its round.
ROUND_AT = 58


#: What a round adds to the shingles' hashes before they are mixed; round 0 takes them as they are.
STEP = 0x9E3779B97F4A7C15


def shingle_hashes(words: list[bytes], n_words: int) -> np.ndarray:
    k = min(n_words, len(words))
    ends = np.cumsum([len(x) + 1 for x in words]).tolist()
    starts, line, digest = [0, *ends], b" ".join(words), xxhash.xxh64_intdigest
    return np.array([digest(line[starts[i] : ends[i + k - 1] - 1], SEED) for i in range(len(words) - k + 1)], dtype=np.uint64)


def mixed(h: np.ndarray, round_: int) -> np.ndarray:
    """The hashes of a round: a bijection of 64 bits (the finaliser of a splittable generator), so that rounds are as good as independent."""
    if not round_:
        return h
    h = h + np.uint64(round_ * STEP & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 65535):
        ones += np.add.reduce(np.unpackbits(h[at : at + 65535].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


MINWISE_BITS = 48


@functools.cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(h: np.ndarray, sizes: tuple[int, ...]) -> list[int]:
    """Numbers of so many bits: each bit a middle one of the smallest of the hashes times an odd number of its own. Hashes are read 1024 at a time."""
    by, least = _multipliers(sum(sizes)), None
    for at in range(0, len(h), 1024):
        low = np.minimum.reduce(h[at : at + 1024, None] * by, axis=0)
        least = low if least is None else np.minimum(least, low)
    ones = (least >> np.uint64(20) & np.uint64(1)).tolist()
    ends = np.cumsum(sizes).tolist()
    return [sum(one << k for k, one in enumerate(ones[end - size : end])) for end, size in zip(ends, sizes, strict=True)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z and splits at ASCII white space only


def fingerprint(text: str | None, n_words: int = WORDS, round_: int = 0) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    w = words_of(text)
    return majority(mixed(shingle_hashes(w, n_words), round_)) if w else 0


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_words: int = WORDS, check_words: int | None = None, key: str | None = None, rounds: int = 1, minwise_bits: bool = False) -> DataFrame:
    """(doc_id, fp, check), with key (a long) if one is named, and fp1, fp2, ... of further rounds: fingerprints as signed longs; check is null without check_words.
    With minwise_bits, bits are minwise ones of shingles of n_words, and check has BITS further ones."""
    checked = check_words or minwise_bits

    def prints(t: str | None) -> list[int]:
        w = words_of(t)
        if not w:
            return [0] * (rounds + 1)
        h = shingle_hashes(w, n_words)
        if minwise_bits:
            return minwise(h, (*[MINWISE_BITS] * rounds, BITS))
        return [*(majority(mixed(h, r)) for r in range(rounds)), majority(shingle_hashes(w, check_words)) if check_words else 0]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([prints(t.as_py()) for t in b.column("text")], dtype=np.uint64).reshape(-1, rounds + 1).view(np.int64)
            check = pa.array(made[:, rounds]) if checked else pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made[:, 0]), check, *([b.column("key")] if key else []), *(pa.array(made[:, r]) for r in range(1, rounds))], names=names)

    own = [docs[key].alias("key")] if key else []
    names = ["doc_id", "fp", "check", *["key"] * bool(key), *[f"fp{r}" for r in range(1, rounds)]]
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), *own).mapInArrow(of, ", ".join(f"{n} long" for n in names))


@functools.cache
def covering_masks(radius: int = RADIUS, bits: int = BITS, level: int = 0) -> list[int]:
    """The masks, as signed longs, of one set of tables."""
    r = random.Random(1000 + level)
    pool = list(range(1, 1 << (radius + 1)))
    vectors = r.sample(pool, bits) if bits <= len(pool) else [pool[k % len(pool)] for k in r.sample(range(bits), bits)]
    masks = []
    for v in range(1, 1 << (radius + 1)):
        m = sum(1 << b for b in range(bits) if (vectors[b] & v).bit_count() % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _forest(fps: np.ndarray, radius: int, checks: np.ndarray | None = None, check_radius: int = BITS) -> list[tuple[int, int]]:
    """Places of the edges of a spanning forest of the links among distinct fingerprints: within both radii, if there are checks."""
    left = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            a = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[a]) <= radius
            if checks is not None:
                near[near] = np.bitwise_count(checks[left[near]] ^ checks[a]) <= check_radius
            for b in left[near].tolist():
                out.append((a, b))
                front.append(b)
            left = left[~near]
    return out


def _kept(path: int, radius: int) -> int:
    """The bits that the tables of a path keep."""
    tables, steps = (1 << (radius + 1)) - 1, []
    path &= (1 << ROUND_AT) - 1
    while path:
        path, k = divmod(path - 1, tables)
        steps.append(k)
    kept = 0
    for level, k in enumerate(reversed(steps)):
        kept |= covering_masks(radius, level=level)[k]
    return kept


def _masked(radius: int, level: int) -> Column:
    """The bits of fp that the tables of a path of that level keep."""
    tables, path, kept = (1 << (radius + 1)) - 1, f"(path & {(1 << ROUND_AT) - 1}L)", None
    for k in range(level, -1, -1):
        masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius, level=k)])
        m = F.element_at(masks, F.expr(f"int(({path} - 1) % {tables}) + 1"))
        kept, path = m if kept is None else kept.bitwiseOR(m), f"(({path} - 1) div {tables})"
    return F.col("fp").bitwiseAND(kept)


class _Buckets:
    """Turns sorted rows (path, masked, fp) or, with a check_radius, (path, masked, fp, check), in pieces, into edges (fp, fp, null) and, for
    buckets that are too large, open nodes (fp, check or 0, path); `rounds` has the round of each."""

    def __init__(self, radius: int, bucket: int, check_radius: int | None = None):
        self.radius, self.bucket, self.check_radius = radius, bucket, check_radius
        self.none = np.empty((3 if check_radius is None else 4, 0), np.int64)
        self.carry = self.none
        self.large: tuple | None = None  # the key of a large bucket whose rows still come
        self.out: tuple[list, list, list] = ([], [], [])
        self.rounds: list[int] = []

    def _open(self, rows: np.ndarray) -> None:
        path = int(rows[0, 0])
        self.out[0].extend(rows[2].tolist())
        self.out[1].extend([0] * rows.shape[1] if self.check_radius is None else rows[3].tolist())
        self.out[2].extend([path] * rows.shape[1])
        self.rounds.extend([path >> ROUND_AT] * rows.shape[1])

    def _edges(self, paths: np.ndarray, a: list, b: list) -> None:
        self.out[0].extend(a)
        self.out[1].extend(b)
        self.out[2].extend([None] * len(a))
        self.rounds.extend((paths >> ROUND_AT).tolist())

    def _too_large(self, rows: np.ndarray) -> bool:
        return rows.shape[1] > self.bucket and BITS - (_kept(int(rows[0, 0]), self.radius) & (1 << BITS) - 1).bit_count() > FREE

    def _bucket(self, rows: np.ndarray) -> None:
        if self._too_large(rows):
            self._open(rows)
        else:
            f = rows[2].tolist()
            checks = () if self.check_radius is None else (rows[3].view(np.uint64), self.check_radius)
            pairs = _forest(rows[2].view(np.uint64), self.radius, *checks)
            self._edges(rows[0, : len(pairs)], [f[x] for x, _ in pairs], [f[y] for _, y in pairs])

    def add(self, rows: np.ndarray) -> None:
        if self.large is not None:
            other = np.flatnonzero((rows[0] != self.large[0]) | (rows[1] != self.large[1]))
            n = int(other[0]) if len(other) else rows.shape[1]
            if n:
                self._open(rows[:, :n])
            rows = rows[:, n:]
            if not rows.shape[1]:
                return
            self.large = None
        rows = np.concatenate((self.carry, rows), axis=1)
        starts = np.flatnonzero(np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))))
        self._whole(rows[:, : starts[-1]], starts)
        self.carry = rows[:, starts[-1] :]
        if self._too_large(self.carry):
            self._open(self.carry)
            self.large, self.carry = (int(self.carry[0, 0]), int(self.carry[1, 0])), self.none

    def end(self) -> None:
        if self.carry.shape[1] > 1:
            self._bucket(self.carry)

    def _whole(self, rows: np.ndarray, starts: np.ndarray) -> None:
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        near = two[np.bitwise_count((rows[2][two] ^ rows[2][two + 1]).view(np.uint64)) <= self.radius]
        if self.check_radius is not None:
            near = near[np.bitwise_count((rows[3][near] ^ rows[3][near + 1]).view(np.uint64)) <= self.check_radius]
        self._edges(rows[0][near], rows[2][near].tolist(), rows[2][near + 1].tolist())
        for k in np.flatnonzero(sizes > 2).tolist():
            self._bucket(rows[:, starts[k] : starts[k + 1]])

    def flush(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in self.out), pa.array(self.rounds, pa.int32())], names=["a", "b", "path", "round"])
        self.out, self.rounds = ([], [], []), []
        return made


#: Rows of an exchange's partition.
PART_ROWS = 400_000


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, check_radius: int | None = None) -> DataFrame:
    """Edges (a, b, round), a > b, between nodes (distinct round and fp; check, if there is a check_radius) of a round that connect exactly what links
    within the radius, or within both, connect. Nodes without a column round are of round 0."""
    carried = ["fp"] if check_radius is None else ["fp", "check"]
    at = F.col("round").cast("long") if "round" in nodes.columns else F.lit(0).cast("long")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Buckets(radius, bucket, check_radius)
        for b in batches:
            if b.num_rows:
                found.add(np.stack([b.column(c).to_numpy() for c in ("path", "masked", *carried)]))
                yield found.flush()
        found.end()
        yield found.flush()

    spark, edges = nodes.sparkSession, []
    tables = (1 << (radius + 1)) - 1
    now = nodes.select(*carried, F.shiftleft(at, ROUND_AT).alias("path"))
    n = nodes.count()
    for level in itertools.count():
        rows = now.repartition(max(1, -(-n * tables // PART_ROWS))).select(*carried, "path", F.explode(F.sequence(F.lit(1), F.lit(tables))).alias("t"))
        # The whole path of tables is part of a bucket's key, as the bits kept depend on it.
        low = F.col("path").bitwiseAND(F.lit((1 << ROUND_AT) - 1))
        rows, masked = rows.select((F.col("path") - low + low * tables + F.col("t")).alias("path"), *carried), _masked(radius, level)
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * tables // PART_ROWS))
        found = materialise(rows.repartition(parts, "path", masked).withColumn("masked", masked).sortWithinPartitions("path", "masked", "fp").mapInArrow(of, "a long, b long, path long, round int"), "simhash-level")
        edges.append(found.where("path IS NULL").select("a", "b", "round"))
        now = found.where("path IS NOT NULL").select(F.col("a").alias("fp"), *[F.col("b").alias(c) for c in carried[1:]], "path")
        n = now.count()
        if not n:
            break
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return materialise(out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "round").where("a != b").distinct(), "simhash-edges")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a > b): the smallest id that it reaches.

    Rounds of large-star and small-star: every node's neighbours are linked to its smallest neighbour. All rounds are
    joins and aggregates over at most as many rows as there are edges."""

    def star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u"))
        return small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()

    def stars(e: DataFrame) -> bool:
        """Every id has one smallest id, which is no id with a smaller one: then nothing is left to do."""
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()

    edges = edges.select("a", "b")
    while not stars(edges):
        edges = materialise(star(edges), "components")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _values(fps: DataFrame, rounds: int, first: int = 0) -> Column:
    """The array of (round, value) of a row's fingerprints, from a round on."""
    return F.array(*[F.struct(F.lit(r).alias("round"), F.col("fp" if not r else f"fp{r}").alias("fp")) for r in range(first, rounds)])


def _nodes(fps: DataFrame, rounds: int) -> DataFrame:
    """(round, fp, id, check): the distinct values of every round with their smallest id and its check fingerprint."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "check"))
    each = fps.select("doc_id", "check", F.inline(_values(fps, rounds)))
    return materialise(each.groupBy("round", "fp").agg(first.alias("x")).select("round", "fp", F.col("x.doc_id").alias("id"), F.col("x.check").alias("check")), "simhash-nodes")


def _across(fps: DataFrame, found: DataFrame, rounds: int) -> DataFrame:
    """Edges of all rounds as one graph. A vertex is a value of a round; a document's vertices hang together by that of round 0, as far as
    they are in a link or several documents' values of round 0 share them."""
    vertex = lambda c: F.when(F.col("round") == 0, F.col(c)).otherwise(F.xxhash64("round", c))
    edges = found.select(vertex("a").alias("a"), vertex("b").alias("b"), "round")
    each = fps.select(F.col("fp").alias("a"), F.inline(_values(fps, rounds, 1)))
    pairs = materialise(each.select("a", vertex("fp").alias("b")).distinct(), "simhash-pairs")
    shared = pairs.groupBy("b").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most").select("b")
    used = shared.unionByName(edges.where("round > 0").select(F.explode(F.array("a", "b")).alias("b"))).distinct()
    out = edges.select("a", "b").unionByName(pairs.join(used, "b", "left_semi").select("a", "b"))
    return materialise(out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "simhash-graph")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_words: int = WORDS, radius: int = RADIUS, check_words: int | None = None, check_radius: int = 16, key: str | None = None, rounds: int = 1, minwise_bits: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs, with key if a column of the rows' own keys (longs) is named. The fingerprint is that of round 0."""
    fps = materialise(fingerprints(docs, text, doc_id, n_words, check_words, key, rounds, minwise_bits), "simhash-fp")
    nodes = _nodes(fps, rounds)
    found = links(nodes, radius, check_radius=check_radius if check_words or minwise_bits else None)
    nodes = nodes.where("round = 0").drop("round")
    label = components(found if rounds == 1 else _across(fps, found, rounds)).withColumnRenamed("id", "fp")
    label = materialise(label.unionByName(label.select(F.col("component").alias("fp"), "component").distinct()), "simhash-components")
    label = materialise(nodes.join(label, "fp"), "simhash-labels")
    least = label.groupBy("component").agg(F.min("id").alias("component_id"))
    owner = label.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    alone = nodes.select("fp", "id").join(owner, F.col("fp") == F.col("_fp"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "id").alias("component_id"))
    return fps.join(alone, F.col("fp") == F.col("_fp"), "left").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", *["key"] * bool(key))
