"""Repair of conversation structure by a dynamic program that runs over many conversations at once.

A conversation's role initials should read `(s?(ua)+)?`. Edits: keep a row (0), rerole it to user or assistant (3), delete it (4), insert an empty
user or assistant row anywhere (3); a truncated row that stays costs 3 more, and blank rows and repeats must go. The cheapest edits are taken, and
of those the ones whose initials (D, I, K, R) in order are ASCII-least.

Rows are sorted once across partitions and cut into stripes of STRIPE rows; a conversation's rows of a stripe are a block, so the work on a long
conversation is split like that on many short ones. Blocks of like length are stacked time-major (turn, block, state) in NumPy, padded to a power of two, and
every turn updates the costs of all states of all blocks at once.

1. Backward costs of a block for each state after it: a (state, state) matrix.
2. Backward over each conversation's matrices: the costs after every block, which depend on the blocks behind it.
3. With them, backward costs are stored for every turn and the edits are traced forward, vectorised over blocks and over the four states a block may start in.
4. Forward over each conversation's blocks: the state in which each starts, which picks its trace.

States: nothing yet, after a system row, after a user row, after an assistant row. A row that must go costs 4 in any state, so it takes part in counts and
traces but not in the program. Texts take no part until the edits are replayed over the sorted rows.

Defined results: a null role or text is one space; a null id is a conversation of its own; null turns come first; rows of an equal turn go by role, then text, in
byte order. Equal rows are one row with a number of copies until edits are replayed. `gaps` beyond 64 bits is null. An empty table gives an empty
result. A role's initial is its first character as it is; an empty role has none. A conversation's matrices (STRIPE rows each) are the
most that meets in one row; the digest reads a conversation's rows one after another in one task, as its hash and edit string are one value. Columns other than
the four named aren't read and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise

STRIPE = 1024
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FAR = 1 << 40  # the cost of what can't be
WHITE = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled row, by the state before; from its value the role follows.
MADE = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept row, by the state before and the row's class (none of s, u, a; s; u; a); -1: not allowed.
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
LEGAL = np.zeros((4, 4), bool)
LEGAL[1, 2] = LEGAL[2, 3] = LEGAL[3, 2] = True
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A row's code is its class, plus LIVE if it may stay, plus CUT if it is truncated.
LIVE, CUT, PAD = 4, 8, 16


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes it a user's."""
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(rows[conv_id]), F.lit(":"), text_of(rows[turn])).cast("binary")) % 20
    r = rows.select(rows[conv_id].cast("long").alias("conv_id"), rows[turn].cast("long").alias("turn"), text_of(rows[role]).alias("role"), text_of(rows[text]).alias("text"), kind.alias("kind")).where("kind <> 0")
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_of = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return r.select("conv_id", "turn", role_of.alias("role"), said.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, code, blank, duplicate, truncated, seq) of the distinct rows: n copies of which `blank` and `duplicate` must go; seq is the place in the order."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    same = rows.select("conv_id", "turn", space("role"), space("text")).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    first = same.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text").alias("_t"), F.col("first.turn").alias("_first"))
    found = same.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text") == F.col("_t")))
    core = F.rtrim("text", F.lit(WHITE))
    blank, earliest = core == "", F.col("turn").eqNullSafe(F.col("_first"))
    live = ~blank & earliest
    cut = live & ~F.substring(core, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    of_class = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    code = of_class + F.when(live, LIVE).otherwise(0) + F.when(cut, CUT).otherwise(0)
    counts = F.when(blank, F.col("n")).otherwise(0), F.when(blank, 0).otherwise(F.col("n") - F.when(earliest, 1).otherwise(0)), F.when(cut, 1).otherwise(0)
    kept = found.select("conv_id", "turn", "role", "text", "n", code.cast("int").alias("code"), *[c.cast("long").alias(k) for c, k in zip(counts, ("blank", "duplicate", "truncated"), strict=True)])
    order = ["conv_id", "turn", "role", "text"]
    return materialise(kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "repair-rows")


def _relaxed(c: np.ndarray) -> np.ndarray:
    """Costs (block, state, ...) with rows inserted before what comes."""
    user, assistant = np.minimum(c[:, USER], INSERT + c[:, ASSISTANT]), np.minimum(c[:, ASSISTANT], INSERT + c[:, USER])
    return np.stack([np.minimum(c[:, START], INSERT + user), np.minimum(c[:, SYSTEM], INSERT + user), user, assistant], axis=1)


#: Costs after the last row.
DONE = _relaxed(np.array([[0, FAR, FAR, 0]]))[0]


def _turn(c: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Costs (block, state, end) before a turn's rows, from those after them."""
    stays = ((code & CUT) > 0).astype(np.int64) * TRUNCATED
    to = KEPT[:, code & 3].T  # (block, state)
    keep = np.where(to[:, :, None] >= 0, np.take_along_axis(c, np.maximum(to, 0)[:, :, None], axis=1), FAR)
    best = np.minimum(np.minimum(keep, c[:, MADE] + REROLE) + stays[:, None, None], c + DELETE)
    return np.where((code == PAD)[:, None, None], c, _relaxed(best))


def buckets(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sequences, their items time-major) of sequences that lie one after another, by length up to a power of two; -1 pads."""
    starts = np.cumsum(lengths) - lengths
    size = np.where(lengths > 0, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64), 0)
    for s in np.unique(size):
        who = np.flatnonzero(size == s)
        at = np.arange(s)[:, None]
        yield who, np.where(at < lengths[who], starts[who] + at, -1)


def _costs(codes: np.ndarray, at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs (turn, block, state, end) before each turn of stacked blocks, and after the last."""
    out = np.empty((len(at) + 1, *after.shape), np.int64)
    out[-1] = after
    for t in range(len(at) - 1, -1, -1):
        out[t] = _turn(out[t + 1], np.where(at[t] >= 0, codes[at[t]], PAD))
    return out


def matrices(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(block, state before, state after) costs of blocks of codes that lie one after another. Rows that aren't live take no part."""
    live, rows = _live(codes, lengths)
    out = np.empty((len(lengths), 4, 4), np.int64)
    ends = np.where(np.eye(4, dtype=bool), 0, FAR)
    for who, at in buckets(rows):
        c = np.broadcast_to(ends, (len(who), 4, 4))
        for t in range(len(at) - 1, -1, -1):  # only the last is needed
            c = _turn(c, np.where(at[t] >= 0, live[at[t]], PAD))
        out[who] = c
    return out


def _live(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = (codes & LIVE) > 0
    return np.append(codes[ok], PAD), np.bincount(np.repeat(np.arange(len(lengths)), lengths)[ok], minlength=len(lengths))


def after_blocks(m: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs (block, state) after each block, from the matrices of conversations' blocks that lie one after another, and the cost of each conversation."""
    out, total = np.empty((len(m), 4), np.int64), np.zeros(len(lengths), np.int64)
    for who, at in buckets(lengths):
        v = np.broadcast_to(DONE, (len(who), 4))
        for t in range(len(at) - 1, -1, -1):
            has = at[t] >= 0
            out[at[t][has]] = v[has]
            v = np.where(has[:, None], (m[at[t]] + v[:, None, :]).min(axis=2), v)
        total[who] = v[:, START]
    return out, total


def trace(codes: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For live rows, start states and slots: letters (row, start, slot), two inserts and the row's own edit, 0 for none; and the states (block, start) after."""
    live, rows = _live(codes, lengths)
    letters, ends = np.zeros((len(live) - 1, 4, 3), np.uint8), np.empty((len(lengths), 4), np.int64)
    for who, at in buckets(rows):
        cost = _costs(live, at, after[who][:, :, None])[..., 0]
        state = np.broadcast_to(np.arange(4), (len(who), 4)).copy()
        for t in range(len(at)):
            has = at[t] >= 0
            now, then, code = cost[t], cost[t + 1], np.where(has, live[at[t]], PAD)
            of = lambda c, s: np.take_along_axis(c, s, axis=1)
            made = np.zeros((len(who), 4, 3), np.uint8)
            for slot in range(2):
                insert = has[:, None] & (of(now, state) != DELETE + of(then, state)) & (of(now, state) == INSERT + of(now, MADE[state]))
                made[insert, slot] = ord("I")
                state = np.where(insert, MADE[state], state)
            stays = ((code & CUT) > 0)[:, None] * TRUNCATED
            to = KEPT[state, (code & 3)[:, None]]
            delete = of(now, state) == DELETE + of(then, state)
            keep = ~delete & (to >= 0) & (of(now, state) == stays + of(then, np.maximum(to, 0)))
            made[:, :, 2] = np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R")))
            state = np.where(~has[:, None] | delete, state, np.where(keep, to, MADE[state]))
            letters[at[t][has]] = made[has]
        ends[who] = state
    return letters, ends


def audits(codes: np.ndarray, copies: np.ndarray, lengths: np.ndarray, letters: np.ndarray) -> list[list[str]]:
    """Of each block the edits for each start state; copies beyond a live row's first, and rows that aren't live, go."""
    live = (codes & LIVE) > 0
    block = np.repeat(np.arange(len(lengths)), lengths)
    out = []
    for start in range(4):
        letter, count = np.zeros((len(codes), 4), np.uint8), np.zeros((len(codes), 4), np.int64)
        letter[live, :3], letter[:, 3] = letters[:, start], ord("D")
        count[:, :3], count[:, 3] = letter[:, :3] > 0, copies - live
        text = np.repeat(letter.ravel(), count.ravel()).tobytes().decode("ascii")
        ends = np.cumsum(np.bincount(block, weights=count.sum(axis=1), minlength=len(lengths)).astype(np.int64)).tolist()
        out.append([text[a:b] for a, b in zip([0, *ends], ends)])
    return [list(x) for x in zip(*out, strict=True)]


def _entries(exits: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state in which each block starts, and that after each conversation."""
    out, last = np.empty(len(exits), np.int64), np.zeros(len(lengths), np.int64)
    for who, at in buckets(lengths):
        s = np.full(len(who), START)
        for row in at:
            has = row >= 0
            out[row[has]] = s[has]
            s = np.where(has, exits[row, s], s)
        last[who] = s
    return out, last


def _lists(c: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return c.flatten(), np.diff(c.offsets.to_numpy())


def _arrow(of: Callable[[pa.RecordBatch], dict], schema: str) -> tuple[Callable, str]:
    """of, from a batch to columns, as the two arguments of mapInArrow."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                made = of(b)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in (made[n] for n in names)], names=names)

    return run, schema


def _rows_of(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).reshape(-1)), m[0].size).cast(pa.list_(pa.int64()))


def _block(seq: Column) -> Column:
    return F.shiftright(seq, STRIPE.bit_length() - 1)


def plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ordered rows: (conv_id, blk, entry, audit) of each block, and (conv_id, cost, illegal, tail) of each conversation; tail is what is inserted after all rows."""
    flat = F.sort_array(F.collect_list(F.struct("seq", "code", "n")))
    blocks = materialise(rows.groupBy("conv_id", _block(F.col("seq")).alias("blk")).agg(flat.alias("rows")).select("conv_id", "blk", F.col("rows.code").alias("code"), F.col("rows.n").alias("n")), "repair-blocks")

    def measured(b: pa.RecordBatch) -> dict:
        code, lengths = _lists(b.column("code"))
        code, n = code.to_numpy().astype(np.int64), b.column("n").flatten().to_numpy()
        kind, ends = code & 3, np.cumsum(lengths) - 1
        inner = np.ones(len(code), bool)
        inner[ends] = False
        bad = n - 1
        bad[:-1] += inner[:-1] & ~LEGAL[kind[:-1], kind[1:]]
        live = (code & LIVE) > 0
        sums = lambda x: np.add.reduceat(x, ends + 1 - lengths)
        return {"conv_id": b.column("conv_id"), "blk": b.column("blk"), "m": _rows_of(matrices(code, lengths).reshape(-1, 16)), "gone": sums(n - live), "bad": sums(bad), "head": kind[ends + 1 - lengths], "last": kind[ends]}

    found = blocks.mapInArrow(*_arrow(measured, "conv_id long, blk long, m array<long>, gone long, bad long, head long, last long"))
    gathered = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("blk", "m", "gone", "bad", "head", "last"))).alias("b"))

    def scanned(b: pa.RecordBatch) -> dict:
        items, lengths = _lists(b.column("b"))
        blk, m, gone, bad, head, last = items.flatten()
        after, total = after_blocks(m.flatten().to_numpy().reshape(-1, 4, 4), lengths)
        ends = np.cumsum(lengths) - 1
        wrong = bad.to_numpy().copy()
        head, last = head.to_numpy(), last.to_numpy()
        inner = np.ones(len(wrong), bool)
        inner[ends] = False
        wrong[:-1] += inner[:-1] & ~LEGAL[last[:-1], head[1:]]
        sums = lambda x: np.add.reduceat(x, ends + 1 - lengths)
        lists = lambda v: pa.ListArray.from_arrays(b.column("b").offsets, v)
        return {"conv_id": b.column("conv_id"), "cost": total + DELETE * sums(gone.to_numpy()), "illegal": sums(wrong), "blk": lists(blk), "after": lists(_rows_of(after))}

    whole = materialise(gathered.mapInArrow(*_arrow(scanned, "conv_id long, cost long, illegal long, blk array<long>, after array<array<long>>")), "repair-costs")
    ends = whole.select(F.col("conv_id").alias("_c"), F.inline(F.arrays_zip(F.col("blk").alias("_blk"), F.col("after").alias("after"))))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("blk") == F.col("_blk"))

    def traced(b: pa.RecordBatch) -> dict:
        code, lengths = _lists(b.column("code"))
        code, n = code.to_numpy().astype(np.int64), b.column("n").flatten().to_numpy()
        letters, exits = trace(code, lengths, b.column("after").flatten().to_numpy().reshape(-1, 4))
        return {"conv_id": b.column("conv_id"), "blk": b.column("blk"), "exits": _rows_of(exits), "audits": pa.array(audits(code, n, lengths, letters), pa.list_(pa.string()))}

    traces = materialise(blocks.join(ends, same).select("conv_id", "blk", "code", "n", "after").mapInArrow(*_arrow(traced, "conv_id long, blk long, exits array<long>, audits array<string>")), "repair-traces")

    def chosen(b: pa.RecordBatch) -> dict:
        items, lengths = _lists(b.column("b"))
        blk, exits = items.flatten()
        entry, last = _entries(exits.flatten().to_numpy().reshape(-1, 4), lengths)
        lists = lambda v: pa.ListArray.from_arrays(b.column("b").offsets, v)
        return {"conv_id": b.column("conv_id"), "blk": lists(blk), "entry": lists(pa.array(entry)), "end": last}

    entries = materialise(traces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("blk", "exits"))).alias("b")).mapInArrow(*_arrow(chosen, "conv_id long, blk array<long>, entry array<long>, end long")), "repair-entries")
    starts = entries.select(F.col("conv_id").alias("_c"), F.inline(F.arrays_zip(F.col("blk").alias("_blk"), F.col("entry").alias("entry"))))
    picked = traces.join(starts, same).select("conv_id", "blk", "entry", F.element_at("audits", (F.col("entry") + 1).cast("int")).alias("audit"))
    tails = entries.select(F.col("conv_id").alias("_c"), F.element_at(F.array(F.lit(""), F.lit("II"), F.lit("I"), F.lit("")), (F.col("end") + 1).cast("int")).alias("tail"), F.col("end"), F.col("blk").alias("_b"))
    last = tails.where("tail <> ''").select(F.col("_c").alias("conv_id"), (F.array_max("_b") + 1).alias("blk"), F.col("end").alias("entry"), F.col("tail").alias("audit"))
    return picked.unionByName(last), whole.select("conv_id", "cost", "illegal")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, blk, edit, role or None, text) of every edit, in order, from sorted blocks' edits each followed by its rows; a deleted row has no role."""
    edits, state, conv, blk = iter(()), START, None, None

    def made(edit: str) -> tuple:
        nonlocal state
        state = int(MADE[state])
        return edit, NAMES[state]

    for b in batches:
        for conv_, blk_, n, code, role, text, entry, audit in zip(*(b.column(c).to_pylist() for c in ("conv_id", "blk", "n", "code", "role", "text", "entry", "audit")), strict=True):
            if audit is not None:
                for e in edits:  # what is inserted after a block's last row
                    yield conv, blk, *made(e), ""
                conv, blk, state, edits = conv_, blk_, entry, iter(audit)
                continue
            for _ in range(n):
                for e in edits:
                    if e == "I":
                        yield conv, blk, *made(e), ""
                        continue
                    if e == "D":
                        yield conv, blk, e, None, text
                    elif e == "R":
                        yield conv, blk, *made(e), text
                    else:
                        state = int(KEPT[state, code & 3])
                        yield conv, blk, e, role, text
                    break
    for e in edits:
        yield conv, blk, *made(e), ""


def _script(rows: DataFrame, plans: DataFrame, by: list[str]) -> DataFrame:
    """Blocks' edits, each before its rows, dealt out and sorted."""
    none = lambda t: F.lit(None).cast(t)
    said = rows.select("conv_id", _block(F.col("seq")).alias("blk"), "seq", "n", "code", "role", "text", none("long").alias("entry"), none("string").alias("audit"))
    todo = plans.select("conv_id", "blk", F.lit(-1).cast("long").alias("seq"), none("long").alias("n"), none("int").alias("code"), none("string").alias("role"), none("string").alias("text"), "entry", "audit")
    return said.unionByName(todo).repartition(*by).sortWithinPartitions("conv_id", "blk", "seq")


REPAIRED = "conv_id long, blk long, place long, edit string, role string, text string"


def repair(rows: DataFrame) -> DataFrame:
    """REPAIRED of (conv_id, turn, role, text) rows: all edits with what they leave, in the order of (blk, place) within a conversation; deleted rows have a null role."""
    lines = ordered(rows)
    plans, _ = plan(lines)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part, place, at = [c.split()[0] for c in REPAIRED.split(", ")], [], 0, None
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)
        for conv, blk, edit, role, text in _replay(batches):
            place = place + 1 if at == (conv, blk) else 0
            at = (conv, blk)
            part.append((conv, blk, place, edit, role, text))
            if len(part) == STRIPE:
                yield batch()
                part = []
        if part:
            yield batch()

    return _script(lines, plans, ["conv_id", "blk"]).mapInArrow(of, REPAIRED)


def digest(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for every conv_id of ids: counts of faults in rows, the cheapest edits, and a hash of the repaired conversation."""
    lines = ordered(rows)
    plans, whole = plan(lines)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, edits, sha, any_ = [], None, [], None, False
        names, types = ["conv_id", "audit", "repaired_sha256"], [pa.int64(), pa.string(), pa.string()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        for conv, _, edit, role, text in _replay(batches):
            if sha is None or conv != now:
                if sha is not None:
                    done.append((now, "".join(edits), sha.hexdigest()))
                    if len(done) == STRIPE:
                        yield batch()
                        done = []
                now, edits, sha, any_ = conv, [], hashlib.sha256(), False
            edits.append(edit)
            if role is not None:
                sha.update(f"{chr(10) * any_}{role}:{text}".encode("utf-8", "surrogatepass"))
                any_ = True
        if sha is not None:
            done.append((now, "".join(edits), sha.hexdigest()))
        if done:
            yield batch()

    texts = _script(lines, plans, ["conv_id"]).mapInArrow(of, "conv_id long, audit string, repaired_sha256 string")
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
    counts = lines.groupBy("conv_id").agg(F.when(F.max("turn").isNull(), F.lit(0)).otherwise(span.try_cast("long")).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    out = ids.select("conv_id").distinct()
    for k, part in enumerate((counts, whole, texts)):
        out = out.join(part.withColumnRenamed("conv_id", f"_c{k}"), F.col("conv_id").eqNullSafe(F.col(f"_c{k}")), "left").drop(f"_c{k}")
    zero = [F.when(F.col("_gone"), 0).otherwise(F.col("gaps")).cast("long").alias("gaps"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]]
    return out.withColumn("_gone", F.col("blank").isNull()).select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
