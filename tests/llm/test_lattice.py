"""Operator 13 against all pairs."""

import itertools
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tessella.llm import lattice_dedup, queries

VEC = "vec_id long, embedding array<float>, label int"


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def plain(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs in double precision."""
    ok = [k for k, r in enumerate(rows) if good(r[1])]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by = defaultdict(list)
    for k in ok:
        by[len(rows[k][1])].append(k)
    for ks in by.values():
        x = np.array([rows[k][1] for k in ks], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            a, b = ks[i], ks[j]
            n[a] += 1
            n[b] += 1
            parent[root(a)] = root(b)
    ids, key = defaultdict(list), lambda v: (v is None, v or 0)
    for k, r in enumerate(rows):
        ids[root(k)].append(r[0])
    return sorted(((r[0], n[k], c := min(ids[root(k)], key=key), c == r[0]) for k, r in enumerate(rows)), key=repr)


def got(df, **given):
    return sorted((tuple(r) for r in lattice_dedup.near_duplicates(df, **given).collect()), key=repr)


def turned(r, v, cos):
    """A vector at that cosine to v, which has unit length."""
    z = r.normal(size=v.shape)
    z -= (z * v).sum(-1, keepdims=True) * v
    z /= np.linalg.norm(z, axis=-1, keepdims=True)
    return cos * v + np.sqrt(1 - cos * cos) * z


def test_decode():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 8)) * 2
    p = lattice_dedup.decode(x)
    assert ((2 * p) % 1 == 0).all() and (p.sum(axis=1) % 2 == 0).all() and (((2 * p) % 2).sum(axis=1) % 8 == 0).all()
    steps = lattice_dedup.neighbours()
    assert len({tuple(s) for s in steps.tolist()}) == 240 and ((steps**2).sum(axis=1) == 2).all()
    own = ((x - p) ** 2).sum(axis=1)
    assert (own[:, None] <= ((x[:, None] - p[:, None] - steps) ** 2).sum(axis=2) + 1e-9).all() and own.max() <= 1 + 1e-9


def test_recall_at_the_threshold():
    r = np.random.default_rng(1)
    v = lattice_dedup.unit(r.normal(size=(4000, 64)))
    found = {}
    for cos in (0.951, 0.97, 0.99):
        w = turned(r, v, cos)
        meet = np.zeros(len(v), bool)
        for t in range(lattice_dedup.TABLES):
            a, b = lattice_dedup.cells(v, t), lattice_dedup.cells(w, t)
            meet |= (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
        found[cos] = meet.mean()
    assert found[0.951] > 0.98 and found[0.97] > 0.998 and found[0.99] == 1


@pytest.mark.parametrize("small, block", [(16, 1024), (3, 1024), (4, 7), (1, 2)])
def test_all_pairs(spark, small, block):
    """Chains and dense groups, whatever the sizes of cells and blocks that are compared apart."""
    r = np.random.default_rng(2)
    seeds = lattice_dedup.unit(r.normal(size=(12, 64)))
    dense = np.concatenate([turned(r, np.repeat(seeds[k : k + 1], 5 * k + 1, axis=0), 0.985 + 0.001 * k) for k in range(12)])
    chain = [seeds[0]]
    for _ in range(20):
        chain.append(turned(r, chain[-1], 0.972))
    vectors = np.concatenate((dense, chain, r.normal(size=(200, 64))))
    rows = [(int(k), [float(x) for x in np.float32(v * (1 + k % 3))], 1) for k, v in zip(r.permutation(len(vectors)), vectors, strict=True)]
    rows += [(1000 + k, rows[k % 40][1], 2) for k in range(100)]  # copies
    df = spark.createDataFrame(rows, VEC).repartition(5)
    want = plain(rows)
    assert sum(x[1] for x in want) > 2000
    assert got(df, small=small, block=block) == want


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    a = [float(x) for x in np.float32(np.random.default_rng(3).normal(size=64))]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0] * 64, 0), (4, [*a[:63], None], 0), (5, [*a[:63], nan], 0), (6, [*a[:63], inf], 0), (7, a, 0), (8, a, 1), (8, a, 1), (None, a, 1), (9, [2 * x for x in a], 0), (10, [-x for x in a], 0),
            (11, a[:8], 0), (12, a[:8], 0), (13, a[:3], 0), (14, [3 * x for x in a[:3]], 0), (15, [1.0], 0), (16, [5.0], 0), (17, [0.0, -0.0, 1.0], 0), (18, [-0.0, 0.0, 2.0], 0), (None, None, 0), (19, None, 0), (20, [3e38] * 64, 0), (21, [1e-30] * 64, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], VEC + ", node int")
    assert got(df) == plain(rows)
    assert got(spark.createDataFrame([], VEC)) == []


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    have = queries.op13_lattice_dedup(spark, "/root/testdata/sf0.01")
    assert have.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in have.collect()), key=repr) == plain(rows)
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(con.execute(queries.oracle_sql()["op13_lattice_dedup"]).fetchall(), key=repr) == plain(rows)


def test_planted_recall(spark):
    """Pairs at cosines from 0.95 on, among others: at least 0.98 of the links are found, and none below."""
    r = np.random.default_rng(4)
    v = lattice_dedup.unit(r.normal(size=(1500, 64)))
    w = np.concatenate([turned(r, v[k::5], cos) for k, cos in enumerate((0.9503, 0.955, 0.96, 0.98, 0.945))])
    rows = [(k, [float(x) for x in np.float32(x)], 0) for k, x in enumerate(np.concatenate((v, w)))]
    have = got(spark.createDataFrame(rows, VEC))
    want = plain(rows)
    links = lambda x: sum(n for _, n, _, _ in x)
    assert links(want) >= 2400 and 0.98 * links(want) <= links(have)
    assert all(h[1] <= w[1] for h, w in zip(have, want, strict=True) if h[0] == w[0])
    assert list(itertools.compress(have, [h[1] == 0 for h in have]))
