"""Near-duplicate embeddings by lattice hashing.

A vector of unit length is projected at random onto POINTS spaces of eight dimensions, and each projection is decoded to the nearest point of the E8 lattice; the
points together are its cell in a table. Besides its own cell, a vector lies in the PROBES cells next to its projection, of those that differ by
lattice neighbours (the 240 shortest vectors, which are all that bound a cell) in one or more spaces, nearest by the distance that they add. Two vectors are
candidates if they share a cell of a table, as its own or a neighbouring one.

Every candidate pair is verified by the cosine in double precision; only pairs at or above the threshold are links. With the settings here a pair whose cosine is 0.95 in 64
dimensions meets with a probability of 0.99, one at 0.97 with more than 0.999; unrelated vectors meet with a probability of 1e-5. Links that don't meet are not found.

Equal vectors are one node with a number of copies. Cells of at most SMALL nodes give their pairs, at most (SMALL - 1) / 2 a node, which are made distinct
and verified by joins. Larger cells are compared in blocks of BLOCK nodes against each other: a task gets two blocks with their vectors, counts links
and gives the edges of a spanning forest of them, never the pairs. A pair that meets in several large cells counts in the first of them alone, and one that meets in a
large cell doesn't count in small ones; for that each node knows its large cells. Nothing is capped: a cell of any size is compared whole.

Defined results: vectors that are null, empty, zero, or that hold null or non-finite components link with nothing, not even their equals; vectors of
different lengths don't link. Vectors whose norm is beyond doubles are scaled first. Equal rows are copies, and count as links of one another. A null id is larger than all others. An
empty table gives an empty result. Other columns aren't carried and may have any name.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise
from tessella.llm.simhash import components

THRESHOLD = 0.95
POINTS, SCALE, PROBES, TABLES = 3, 1.4, 12, 3
#: Of each space, so many of the nearest neighbours are combined.
NEAR = 4
SMALL, BLOCK = 16, 1024


@functools.cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [[s if k == i else t if k == j else 0 for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array([*whole, *half], np.float64)


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    off = x[odd] - r[odd]
    worst = np.abs(off).argmax(axis=1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: integers or halves, of even sum."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.cache
def _table(table: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's projections (size, 8 * POINTS) and odd multipliers of the cells' hashes."""
    r = np.random.default_rng([13, table, size])
    m = r.normal(size=(size, 8 * POINTS))
    q = np.linalg.qr(m)[0] if size >= 8 * POINTS else m / np.sqrt(size)
    return q * np.sqrt(size / 8) * SCALE, r.integers(1 << 62, size=8 * POINTS, dtype=np.int64) * 2 + 1


def cells(unit: np.ndarray, table: int) -> np.ndarray:
    """The hashes (vector, 1 + PROBES) of a table's cells in which vectors of unit length lie, their own first."""
    project, mix = _table(table, unit.shape[1])
    cost, code = np.zeros((len(unit), 1)), np.full((len(unit), 1), table * 2 + 1, np.int64)
    for p in range(POINTS):
        at, m = unit @ project[:, 8 * p : 8 * p + 8], mix[8 * p : 8 * p + 8]
        point = decode(at)
        towards = (at - point) @ neighbours().T
        near = np.argpartition(-towards, NEAR, axis=1)[:, :NEAR]
        more = np.concatenate((np.zeros((len(unit), 1)), 2 - 2 * np.take_along_axis(towards, near, axis=1)), axis=1)
        own = (2 * point).astype(np.int64) @ m
        step = ((2 * neighbours()).astype(np.int64) @ m)[near]
        hashes = np.concatenate((own[:, None], own[:, None] + step), axis=1)
        cost, code = (cost[:, :, None] + more[:, None, :]).reshape(len(unit), -1), (code[:, :, None] + hashes[:, None, :]).reshape(len(unit), -1)
        first = np.argsort(cost, axis=1, kind="stable")[:, : PROBES + 1]
        cost, code = np.take_along_axis(cost, first, axis=1), np.take_along_axis(code, first, axis=1)
    return code


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors of unit length) of a column of lists, by length."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy())
    size = np.diff(ends, prepend=0)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, unit(flat[(ends[rows] - n)[:, None] + np.arange(n)])


def nodes(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(node, vector, id, n): the distinct vectors that may link, with their smallest id and number of copies."""
    c = vectors[embedding]
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    ids = vectors[vec_id].cast("long")
    same = vectors.where(good).select(c.alias("vector"), ids.alias("id")).groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return materialise(same.withColumn("node", F.monotonically_increasing_id()), "lattice-nodes")


def memberships(found: DataFrame, tables: int = TABLES) -> DataFrame:
    """(cell, node) of every cell in which a node lies, own or neighbouring."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("node").to_numpy()
            for rows, v in _vectors(b.column("vector")):
                for t in range(tables):
                    made = cells(v, t)
                    yield pa.RecordBatch.from_arrays([pa.array(made.reshape(-1)), pa.array(np.repeat(ids[rows], made.shape[1]))], names=["cell", "node"])

    return found.select("node", "vector").mapInArrow(of, "cell long, node long")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """The edges of a spanning forest of a symmetric matrix of links."""
    left, out = np.arange(len(near)), []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            a = front.pop()
            hit = near[a, left]
            new = left[hit].tolist()
            out.extend((a, b) for b in new)
            front.extend(new)
            left = left[~hit]
    return out


def _again(cell: int, large: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs (a, b) meet in a large cell before this one."""
    before = [x[x < cell] for x in large]
    width = max(map(len, before), default=0)
    if not width:
        return np.zeros(len(a), bool)
    m = np.stack([np.pad(x, (0, width - len(x)), constant_values=cell) for x in before])
    out = np.zeros(len(a), bool)
    for k in range(width):
        out |= ((m[a, k : k + 1] == m[b]) & (m[b] < cell)).any(axis=1)
    return out


def _compared(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of two blocks of a large cell (or one): the nodes, their links counted here, and edges of a forest of all links."""
    ids, copies, side = (rows.column(c).to_numpy() for c in ("node", "n", "side"))
    large = [np.array(x, np.int64) for x in rows.column("large").to_pylist()]
    links, edges, cell = np.zeros(len(ids), np.int64), [], rows.column("cell")[0].as_py()
    apart = rows.column("i")[0] != rows.column("j")[0]
    for at, v in _vectors(rows.column("vector").combine_chunks()):
        near = v @ v.T >= threshold
        np.fill_diagonal(near, False)
        if apart:  # pairs within a block are compared where it meets itself
            near &= side[at][:, None] != side[at]
        a, b = np.nonzero(np.triu(near))
        a, b = at[a], at[b]
        count = ~_again(cell, large, a, b)
        np.add.at(links, a[count], copies[b[count]])
        np.add.at(links, b[count], copies[a[count]])
        edges += [(int(ids[at[x]]), int(ids[at[y]])) for x, y in _forest(near)]
    return ids, links, edges


FOUND = "a long, b long, links long"


def large_links(found: DataFrame, members: DataFrame, sizes: DataFrame, threshold: float, block: int) -> DataFrame:
    """FOUND of cells with more than SMALL nodes: (node, null, links) and edges (a, b, null). sizes: (cell, size) of the large cells."""
    mine = members.join(sizes, "cell")
    blocks = F.ceil(F.col("size") / block).cast("int")
    lists = members.join(sizes, "cell").groupBy("node").agg(F.array_sort(F.collect_set("cell")).alias("large"))  # at most all cells of a node
    dealt = mine.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = dealt.select("cell", "node", "mine", other).select("cell", "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    rows = pairs.join(lists, "node").join(found.select("node", "vector", "n"), "node")

    def of(rows: pa.Table) -> pa.Table:
        ids, links, edges = _compared(rows, threshold)
        some = links > 0
        cols = [*ids[some].tolist(), *(a for a, _ in edges)], [*[None] * int(some.sum()), *(b for _, b in edges)], [*links[some].tolist(), *[None] * len(edges)]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])

    return rows.groupBy("cell", "i", "j").applyInArrow(of, FOUND)


def small_links(found: DataFrame, members: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """FOUND of cells with at most SMALL nodes: edges (a, b, 0), each a link, of pairs that don't meet in a large cell."""
    grouped = members.join(sizes.withColumnRenamed("cell", "_cell"), F.col("cell") == F.col("_cell"), "left_anti").groupBy("cell").agg(F.sort_array(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    each = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = grouped.select(F.inline(each)).distinct()
    lists = members.join(sizes, "cell").groupBy("node").agg(F.collect_set("cell").alias("large"))
    known = found.select("node", "vector").join(lists, "node", "left")
    for side in "ab":
        pairs = pairs.join(known.select(F.col("node").alias(f"_{side}"), F.col("vector").alias(f"v{side}"), F.col("large").alias(f"l{side}")), F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    apart = F.col("la").isNull() | F.col("lb").isNull() | ~F.arrays_overlap("la", "lb")
    pairs = pairs.where(apart & (F.size("va") == F.size("vb"))).select("a", "b", "va", "vb")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = b.column("a"), b.column("b")
            keep = np.zeros(b.num_rows, bool)
            for (rows, v), (_, w) in zip(_vectors(b.column("va")), _vectors(b.column("vb")), strict=True):
                keep[rows] = (v * w).sum(axis=1) >= threshold
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([one.filter(mask), two.filter(mask), pa.array(np.zeros(int(keep.sum()), np.int64))], names=["a", "b", "links"])

    return pairs.mapInArrow(of, FOUND)


def near_duplicates(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD, tables: int = TABLES, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors."""
    found = nodes(vectors, embedding, vec_id)
    members = materialise(memberships(found, tables).distinct(), "lattice-cells")
    sizes = materialise(members.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > small), "lattice-large")
    links = materialise(small_links(found, members, sizes, threshold).unionByName(large_links(found, members, sizes, threshold, block)), "lattice-links")
    edges = links.where("b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    copies = found.select("node", F.col("n").alias("copies"))
    pairs = links.where("b IS NOT NULL AND links = 0")  # each end has as many links as the other has copies
    ends = pairs.select(F.col("a").alias("of"), F.col("b").alias("node")).unionByName(pairs.select(F.col("b").alias("of"), F.col("a").alias("node")))
    per_node = ends.join(copies, "node").select(F.col("of").alias("node"), F.col("copies").alias("links")).unionByName(links.where("b IS NULL").select(F.col("a").alias("node"), "links"))
    total = per_node.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(edges).withColumnRenamed("id", "node")
    label = materialise(label.unionByName(label.select(F.col("component").alias("node"), "component").distinct()), "lattice-components")
    least = label.join(found.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("component_id"))
    owner = label.join(least, "component").select("node", "component_id")
    known = found.join(total, "node", "left").join(owner, "node", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].alias("embedding"))
    out = rows.join(known, F.col("embedding") == F.col("vector"), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
