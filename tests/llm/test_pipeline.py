"""The pipeline's stages against brute force, each on what its predecessor kept."""

import math
import random
from collections import Counter

import corpus_pipeline
import pytest
import xxhash
from tests.llm.test_native import base_of, measures
from tests.llm.test_python import brute_leaks, check_packed

from tessella.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def kept_by_rules(rows):
    ok = {}
    for r in rows:
        m = measures(r["text"])
        ok[r["doc_id"]] = m[0] >= 50 and 100 * m[4] <= 50 * m[0]
    n, f = Counter(r["source"] for r in rows), Counter(r["source"] for r in rows if not ok[r["doc_id"]])
    total, mean = sum(n.values()), sum(f.values()) / sum(n.values())
    within = mean * (1 - mean)
    spread = sum(n[h] * (f[h] / n[h] - mean) ** 2 for h in n)
    rho = (spread - (len(n) - 1) * within) / ((total - sum(x * x for x in n.values()) / total - (len(n) - 1)) * within)
    k = min(1e6, 1 / rho - 1) if rho > 0 else 1e6
    bad = {h for h in n if (f[h] + mean * k) / (n[h] + k) > 0.5}
    return [r for r in rows if ok[r["doc_id"]] and r["source"] not in bad]


def redacted(text):
    out, at = [], 0
    for kind, a, b in base_of(text):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def prints(text):
    """The rounds' fingerprints and the check of a text, bit by bit."""
    w = simhash.words_of(text)
    if not w:
        return [0] * corpus_pipeline.ROUNDS, 0
    n = min(corpus_pipeline.WORDS, len(w))
    h = {xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(len(w) - n + 1)}
    bits = [min(x * int(m) % 2**64 for x in h) >> 20 & 1 for m in simhash._multipliers(corpus_pipeline.ROUNDS * 48 + 64)]
    number = lambda b: sum(x << k for k, x in enumerate(b))
    return [number(bits[48 * k : 48 * k + 48]) for k in range(corpus_pipeline.ROUNDS)], number(bits[-64:])


def fast(text):
    w = simhash.words_of(text)
    made = simhash.minwise(simhash.shingle_hashes(w, corpus_pipeline.WORDS), (*[48] * corpus_pipeline.ROUNDS, 64)) if w else [0] * (corpus_pipeline.ROUNDS + 1)
    return made[:-1], made[-1]


def test_minwise_bits_one_by_one():
    for t in ["one", "a b c d e f", " ".join(f"w{k % 70} x{k}" for k in range(900)), "", "É é " * 40]:
        assert fast(t) == prints(t)


def near(a, b):
    return (a[1] ^ b[1]).bit_count() <= corpus_pipeline.CHECK_RADIUS and min((x ^ y).bit_count() for x, y in zip(a[0], b[0], strict=True)) <= corpus_pipeline.RADIUS


def linked(rows):
    """Components of links: one of the rounds' fingerprints and the check within their radii."""
    made = {r["doc_id"]: fast(r["text"]) for r in rows}
    ids = sorted(made)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if near(made[a], made[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def similar_pairs(sets, least=0.8):
    """Pairs of equal ids' sets with a Jaccard similarity of at least that, identical sets left out: a pair shares one of its rarest shingles."""
    count = Counter(h for s in sets.values() for h in s)
    seen, out = {}, set()
    for i in sorted(sets, key=lambda i: len(sets[i])):
        s, near = sets[i], set()
        rare = sorted(s, key=lambda h: (count[h], h))[: len(s) - math.ceil(least * len(s)) + 1]
        for h in rare:
            near.update(seen.get(h, ()))
            seen.setdefault(h, []).append(i)
        out |= {(j, i) for j in near if sets[j] != s and len(sets[j] & s) >= least * len(sets[j] | s)}
    return out


def share(pairs):
    """How many of the pairs of texts are links, by fast fingerprints."""
    made = {t: fast(t) for t in {t for p in pairs for t in p}}
    return sum(near(made[a], made[b]) for a, b in pairs) / len(pairs)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_similar_pairs(spark, sf):
    """Pairs of the tables with a five-word similarity of 0.8 and more; no setting was chosen on them."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").where("length(text) > 200")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    pairs = [(texts[a], texts[b]) for a, b in similar_pairs({i: shingles(t) for i, t in texts.items()})]
    assert len(pairs) > 10 and share(pairs) >= 0.95, (share(pairs), len(pairs))


@pytest.mark.parametrize("kind", ["insert", "delete", "cut", "replace", "scatter"])
def test_recall_of_planted_pairs(kind):
    """Texts of 40 to 2000 words and copies edited in a block or in single words, by similarity: at least 0.9 of those of 0.8 to 0.85 and 0.98 above, and few below 0.55."""
    r = random.Random(kind)
    vocabulary = ["".join(r.choice("aeioubdfgklmnprst") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    found = {"low": [], "mid": [], "high": []}
    for n in range(900):
        w = [vocabulary[int(5000 * r.random() ** 3)] for _ in range(int(40 * 50 ** r.random()))]
        k = max(1, int(len(w) * r.choice([0.05, 0.1, 0.15, 0.19, 0.23, 0.6, 0.9])))
        at = r.randrange(len(w) - k + 1)
        v = list(w)
        if kind == "insert":
            v[at:at] = r.choices(vocabulary, k=k)
        elif kind == "delete":
            del v[at : at + k]
        elif kind == "cut":
            v = v[:-k]
        elif kind == "replace":
            v[at : at + k] = r.choices(vocabulary, k=k)
        else:
            for p in r.sample(range(len(v)), max(1, k // 6)):
                v[p] = r.choice(vocabulary)
        a, b = " ".join(w), " ".join(v)
        x, y = shingles(a), shingles(b)
        j = len(x & y) / len(x | y)
        for band, lo, hi in (("low", 0, 0.55), ("mid", 0.8, 0.85), ("high", 0.85, 1)):
            if lo <= j < hi:
                found[band].append((a, b))
    assert min(map(len, found.values())) >= 20, {k: len(v) for k, v in found.items()}
    assert share(found["mid"]) >= 0.9 and share(found["high"]) >= 0.98 and share(found["low"]) <= 0.02, {k: share(v) for k, v in found.items()}


def test_no_group_without_common_shingles(spark):
    rows = kept_by_rules([r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])
    label, sets = linked(rows), {r["doc_id"]: shingles(r["text"]) for r in rows}
    groups = {}
    for i, o in label.items():
        groups.setdefault(o, []).append(i)
    assert all(any(sets[i] & sets[j] for j in g if i != j) for g in groups.values() if len(g) > 1 for i in g)


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]

    def step(name, docs, rows):
        got = stages[name](spark, docs, SF)
        assert got.columns == docs.columns
        got = spark.createDataFrame(got.collect(), docs.schema)
        assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()) == sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows), name
        return got

    rows = kept_by_rules(rows)
    docs = step("quality rules", docs, rows)
    label = linked(rows)
    rows = [r for r in rows if label[r["doc_id"]] == r["doc_id"]]
    docs = step("SimHash near-dedup", docs, rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in rows], items)}
    rows = [r for r in rows if r["doc_id"] not in leaked]
    docs = step("benchmark decontamination", docs, rows)
    rows = [r | {"text": redacted(r["text"])} for r in rows]
    rows = [r | {"n_chars": len(r["text"])} for r in rows]
    docs = step("secret scans", docs, rows)
    t = Tokenizer.from_file(queries.tokenizer_path())
    check_packed(stages["best-fit packing"](spark, docs, SF).collect(), {r["doc_id"]: t.encode(r["text"], add_special_tokens=False).ids + [2] for r in rows}, 1024)


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(80))
    data = [(1, text, "en", "a", 0), (1, text, "en", "a", 0), (2, text, "en", None, 0), (3, None, None, None, None), (None, text + " other", "en", "b", 0), (None, text + " token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", "en", "b", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())
    assert [i for i, _ in got] == [0, 0, 1] and sum("<assign>" in t for _, t in got) == 1
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_texts_of_one_id_and_rows_that_differ_elsewhere(spark):
    """Near copies under one id leave one of them; copies of a text under one id, with and without equal columns, are one group."""
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.createDataFrame([(4, text, "a"), (4, text + " end", "a"), (4, text, "a"), (9, "another text", "a"), (9, "another text", "b"), (None, text, "c")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or 0, r["text"], r["source"]) for r in dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF).collect())
    assert got[0] == (0, text, "c") and got[-2:] == [(9, "another text", "a"), (9, "another text", "b")] and len(got) == 4 and got[1][0] == 4


def test_verdicts_are_on_rows(spark):
    """Of two texts under one id only the copy or leak goes; a leak without an id goes too."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    copy, other = " ".join(f"w{k}" for k in range(80)), " ".join(f"other{k} word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, copy), (2, copy), (2, other), (3, item), (3, other + " more"), (None, item)], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in stages["SimHash near-dedup"](spark, docs.where("doc_id < 3"), SF).collect())
    assert got == [(1, copy), (2, other)]
    got = sorted((r["doc_id"], r["text"]) for r in stages["benchmark decontamination"](spark, docs, SF).collect())
    assert got == sorted([(1, copy), (2, copy), (2, other), (3, other + " more")])
