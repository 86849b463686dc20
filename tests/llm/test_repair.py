"""Operator 11 against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import queries, structure_repair

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def plain(rows):
    """The columns of a conversation's rows, by a search forward over (row, roles so far) with whole edit strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, r, x in rows:
        core = x.rstrip(SPACE)
        faults.append("blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((r, x))

    @functools.cache
    def best(i, state):
        """(cost, edits, rows) least from row i on; state: what came last."""
        go = {"": "u", "s": "u", "u": "a", "a": "u"}
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            _, _, r, x = rows[i]
            c, e, out = best(i + 1, state)
            found.append((c + 4, "D" + e, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if r[:1] and r[0] in ("su" if state == "" else go[state]):
                    c, e, out = best(i + 1, r[0])
                    found.append((c + more, "K" + e, ((r, x), *out)))
                name = {"u": "user", "a": "assistant"}[go[state]]
                c, e, out = best(i + 1, go[state])
                found.append((c + more + 3, "R" + e, ((name, x), *out)))
        return with_insert(i, state, tuple(found))

    def with_insert(i, state, found):
        go = {"": "u", "s": "u", "u": "a", "a": "u"}
        found = list(found)
        for n in (1, 2):  # inserts before row i, then an edit of row i or the end
            s, names = state, []
            for _ in range(n):
                s = go[s]
                names.append(({"u": "user", "a": "assistant"}[s], ""))
            for c, e, out in plain_step(i, s):
                found.append((c + 3 * n, "I" * n + e, (*names, *out)))
        return min(found, key=lambda f: (f[0], f[1])) if found else (10**9, "", ())

    def plain_step(i, state):
        go = {"": "u", "s": "u", "u": "a", "a": "u"}
        if i == len(rows):
            return [(0, "", ())] if state in ("", "a") else []
        _, _, r, x = rows[i]
        c, e, out = best(i + 1, state)
        made = [(c + 4, "D" + e, out)]
        if faults[i] not in ("blank", "duplicate"):
            more = 3 * (faults[i] == "truncated")
            if r[:1] and r[0] in ("su" if state == "" else go[state]):
                c, e, out = best(i + 1, r[0])
                made.append((c + more, "K" + e, ((r, x), *out)))
            c, e, out = best(i + 1, go[state])
            made.append((c + more + 3, "R" + e, (({"u": "user", "a": "assistant"}[go[state]], x), *out)))
        return made

    cost, edits, out = best(0, "")
    turns = [t for _, t, _, _ in rows if t is not None]
    pairs = ["".join((a[2][:1], b[2][:1])) for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    }


def expected(rows):
    by = {}
    for r in damaged(rows):
        by.setdefault(r[0], []).append(r)
    return {c: plain(by.get(c, [])) for c in {r[0] for r in rows}}


def got(df):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}


def digest(rows):
    return got(structure_repair.digest(structure_repair.damage(rows), rows))


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_structure_repair(spark, SF)) == expected(rows)


def random_rows(seed, conversations, turns):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "tool", "", "User", None], ["Yes.", "no", " \n", "", "Why? ", "a.b", None, "Well!\t"]
    out = []
    for c in range(conversations):
        for t in range(r.randint(1, turns)):
            out.append((c if c else None, r.choice([t, t, t, 3, None, t * 2]), r.choice(roles[:3] if r.random() < 0.8 else roles), r.choice(texts) if r.random() < 0.5 else f"text {r.randint(0, 9)}{r.choice('.x!')}"))
    return out


@pytest.mark.parametrize("stripe", [1024, 4])
def test_random(spark, monkeypatch, stripe):
    """Also with blocks of at most four rows, so that most conversations are split."""
    monkeypatch.setattr(structure_repair, "STRIPE", stripe)
    rows = random_rows(stripe, 300, 14)
    df = spark.createDataFrame(rows, CONV).repartition(5)
    want = expected(rows)
    assert digest(df) == want
    edits = {}
    for x in structure_repair.repair(structure_repair.damage(df)).orderBy("conv_id", "blk", "place").collect():
        edits.setdefault(x["conv_id"], []).append(x)
    for c, e in want.items():
        e = e["audit"]
        mine = edits.get(c, [])
        assert "".join(x["edit"] for x in mine) == e
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in mine if x["role"] is not None))


def test_edges(spark):
    big = 9223372036854775807
    rows = [(1, None, None, None), (2, big, "user", "a."), (2, -big, "assistant", "b."), (3, 0, "system", "S" + " " * 100_000), *[(4, 0, "user", "again.")] * 50, (5, 1, "assistant", "x" * 1_000_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], CONV + ", blk int")
    have, want = digest(df), expected(rows)
    want[2]["gaps"] = None
    assert have == want
    assert digest(spark.createDataFrame([], CONV)) == {}
    assert structure_repair.repair(spark.createDataFrame([], CONV)).count() == 0


def test_dropped_conversation(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = digest(spark.createDataFrame([(c, 0, "user", "x.")], CONV))[c]
    assert row == {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_hot_conversation(spark):
    """A conversation of 20,000 rows is split into stripes and costs what the program over one block says."""
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant"]), f"t{t}{r.choice('.x')}") for t in range(20_000)] + [x for x in random_rows(1, 50, 8) if x[0] != 7]
    df = spark.createDataFrame(rows, CONV)
    have = digest(df)
    mine = sorted((x for x in damaged(rows) if x[0] == 7), key=lambda x: x[1:])
    codes, seen = [], set()
    for x in mine:
        live = bool(x[3].strip()) and x[2:] not in seen
        seen.add(x[2:])
        codes.append({"u": 2, "a": 3}[x[2][0]] + 4 * live + 8 * (live and x[3][-1] not in ".!?"))
    m = structure_repair.matrices(np.array(codes), np.array([len(codes)]))
    assert have[7]["cost"] == int((m[0, 0] + structure_repair.DONE).min()) + 4 * sum(not c & 4 for c in codes)
    assert len(have[7]["audit"].replace("I", "")) == len(mine)
    assert {k: v for k, v in have.items() if k != 7} == expected([x for x in rows if x[0] != 7])
