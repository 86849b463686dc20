"""Sharding by histogram sort, in DataFrame functions only.

Rows are ordered by (key, tie): key is a 62-bit hash of the text, so equal texts are neighbours, tie a 62-bit hash
of the id. Splitters between shards are searched by counting, in every round, the exact bytes in the cells between
candidate boundaries over all rows; each splitter's cell is cut again until the bytes below it are within the
tolerance of the wanted share, or the cell is one key; then its ties are searched the same way, so that a group of
copies that is larger than a shard is cut as well. A round sends shards * PROBES numbers to the driver, whatever the
input. Once the splitters are known, rows are exchanged once, sorted, for their numbers in the shard: slots follow the order
of (key, tie). The exchange deals a shard out by equal cells of the key; a key that outweighs a cell is cut by its ties.

Law: `bytes` - the shards' sizes are near equal (within the tolerance and one row).

Defined results: a null text is an empty text of size 8 and CRC 0. Rows with equal id and text (null ids are equal) are
one place in the order; where a splitter falls on them, they are numbered and cut by their numbers. Rows that no splitter cuts go to one shard, and
are numbered in one task if they are equal in id and text too: less than a shard. Fewer rows than shards leave shards empty. An
empty table gives an empty result. Other columns are carried along by `assign`; result names replace them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import gapless, let, materialise

SPAN = 1 << 62
PROBES = 256
OVERHEAD = 8


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def hash62(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 2)


@dataclass
class Splitter:
    """Rows below it go to lower shards: key < key0, or key = key0 and tie < tie0, and of the rows at (key0, tie0) the first `cut`."""

    want: float
    cell: list[int] = field(default_factory=lambda: [0, SPAN])  # where it still can be, in the searched dimension
    below: int = 0  # bytes below the cell
    key: int | None = None  # set when only ties are left to search
    cut: int = 0
    done: bool = False

    @property
    def place(self) -> tuple[bool, int, int, int]:
        return (self.key is not None, self.key or 0, *self.cell)

    @property
    def bound(self) -> tuple[int, int, int]:
        return (self.cell[0], 0, 0) if self.key is None else (self.key, self.cell[0], self.cut)


def _search(keys: DataFrame, splitters: list[Splitter], slack: float, probes: int) -> None:
    """One round: cut the open cells into at most `probes` parts, sum all rows by part, and keep for every splitter the part it is in."""
    cells = sorted({s.place for s in splitters if not s.done})
    steps = [max(1, -(-(hi - lo) // probes)) for _, _, lo, hi in cells]
    cell = F
    for n, (by_tie, key, lo, hi) in enumerate(cells):
        value = F.col("tie") if by_tie else F.col("key")
        inside = (value >= lo) & (value < hi)
        cell = cell.when(inside & (F.col("key") == key) if by_tie else inside, n)
    pick = lambda xs, kind: F.get(F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>"), F.col("cell"))
    placed = keys.withColumn("cell", cell).where(F.col("cell").isNotNull())
    value = F.when(pick([int(c[0]) for c in cells], "int") == 1, F.col("tie")).otherwise(F.col("key"))
    parts = placed.select("cell", (value - pick([c[2] for c in cells], "bigint")).alias("at"), pick(steps, "bigint").alias("step"), "size").select("cell", F.expr("at div step").alias("part"), "size")
    sums = {(r["cell"], r["part"]): r for r in parts.groupBy("cell", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()}
    for s in splitters:
        if s.done:
            continue
        n = cells.index(s.place)
        lo, hi = s.cell
        got, rows, p = 0, 0, 0
        for p in range(-(-(hi - lo) // steps[n])):
            r = sums.get((n, p))
            got, rows = (r["bytes"], r["rows"]) if r else (0, 0)
            if s.below + got > s.want:
                break
            s.below += got
        s.cell = [lo + p * steps[n], min(hi, lo + (p + 1) * steps[n])]
        under, over = s.want - s.below, s.below + got - s.want
        if min(under, over) > slack and rows > 1 and s.key is not None and s.cell[1] - s.cell[0] == 1:
            s.cut, s.done = min(rows, max(0, round(under * rows / got))), True  # equal rows
        elif min(under, over) <= slack or rows <= 1:
            s.done = True
            if over < under:
                s.below, s.cell = s.below + got, [s.cell[1], s.cell[1]]
        elif s.cell[1] - s.cell[0] == 1:
            s.key, s.cell = s.cell[0], [0, SPAN]


def find_splitters(keys: DataFrame, shards: int, tolerance: float, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """The shards - 1 boundaries (key, tie, cut) of keys (columns key, tie, size). tolerance: bytes off a boundary's wanted place, as a share of a shard's mean."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    splitters = [Splitter(want=total * k / shards) for k in range(1, shards)]
    while any(not s.done for s in splitters):
        _search(keys, splitters, tolerance * total / shards, probes)
    return sorted(s.bound for s in splitters)


def shard_of(key: Column, tie: Column, splitters: list[tuple[int, int, int]], number: Column | None = None) -> Column:
    """The number of splitters at or below (key, tie, number), by bisection: a tree of comparisons. number: a row's place among those of its key
    and tie, needed only where a splitter cuts them."""

    def below(k: int, t: int, cut: int) -> Column:
        if not t and not cut:
            return key < F.lit(k)
        last = F.lit(False) if not cut or number is None else (tie == F.lit(t)) & (number < F.lit(cut))
        return (key < F.lit(k)) | ((key == F.lit(k)) & ((tie < F.lit(t)) | last))

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(*splitters[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(splitters))


def heavy_keys(keys: DataFrame, cells: int) -> DataFrame:
    """(cell, heavy): the keys, sorted, that outweigh an equal share of all bytes, each with the step that cuts its ties into such shares. Fewer than `cells` keys."""
    share = (keys.agg(F.sum("size")).first()[0] or 0) / cells
    by_key = keys.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > share)
    step = F.ceil(F.lit(float(SPAN)) / F.ceil(F.col("bytes") / F.lit(max(share, 1.0)))).cast("long")
    return by_key.groupBy(cell_of(F.col("key"), cells).alias("_at")).agg(F.sort_array(F.collect_list(F.struct("key", step.alias("step")))).alias("_heavy"))


def cell_of(key: Column, cells: int) -> Column:
    return F.shiftright(key, 62 - cells.bit_length() + 1).cast("int")


#: Bytes of text in a partition of the exchange.
PART_BYTES = 64 << 20


def assign(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id", tolerance: float = 0.001) -> DataFrame:
    """docs with size, shard and slot (gapless from 0 in each shard, in the order of key and tie)."""
    own = ["_key", "_tie", "_number", "_at", "_heavy", "_part", "_step"]
    carried = [c for c in docs.columns if c not in ("size", "shard", "slot", *own)]
    keyed = docs.select(*carried, size_of(docs[text]).alias("size"), hash62(docs[text]).alias("_key"), hash62(docs[doc_id]).alias("_tie"), F.lit(0).cast("long").alias("_number"))
    keys = materialise(keyed.select(F.col("_key").alias("key"), F.col("_tie").alias("tie"), "size"), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    cut = F.lit(False)
    for k, t in sorted({(k, t) for k, t, c in splitters if c}):
        cut = cut | ((F.col("_key") == F.lit(k)) & (F.col("_tie") == F.lit(t)))
    if any(c for _, _, c in splitters):  # equal rows that a splitter cuts: written once, so that their numbers hold
        equal = materialise(keyed.where(cut).withColumn("_row", F.monotonically_increasing_id()), "shard-equal")
        keyed = keyed.where(~cut).unionByName(gapless(equal.drop("_number"), ["_key", "_tie"], ["_row"], "_number").drop("_row"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(keys.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    cells = 1 << max(10, (4 * parts - 1).bit_length())
    placed = keyed.withColumns({"shard": shard_of(F.col("_key"), F.col("_tie"), splitters, F.col("_number")), "_at": cell_of(F.col("_key"), cells)})
    placed = placed.join(F.broadcast(heavy_keys(keys, cells)), "_at", "left")
    # Parts of a cell, in order: below its first heavy key, that key, between it and the next, and so on; a heavy key's part goes on by steps of its ties.
    mine = let(F.col("_key"), lambda k: F.get(F.filter("_heavy", lambda h: h["key"] == k), 0)["step"])
    part = let(F.col("_key"), lambda k: 2 * F.size(F.filter("_heavy", lambda h: h["key"] < k)) + F.exists("_heavy", lambda h: h["key"] == k).cast("int"))
    placed = placed.withColumns({"_part": F.when(F.col("_heavy").isNull(), 0).otherwise(part), "_step": F.coalesce(F.expr("_tie").cast("long") / mine, F.lit(0)).cast("int")}).drop("_heavy")
    slices = ["_at", "_part", "_step"]
    return gapless(placed.repartition(parts, "shard", *slices), ["shard"], ["_key", "_tie", "_number"], "slot", slices=slices).drop(*own)
