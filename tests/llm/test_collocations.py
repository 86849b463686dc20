"""Operator 12 against a plain count, and its query against its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tessella.llm import collocations, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string"


def plain(rows, least=10, least_words=2, most_words=3, share=50):
    n, f = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, most_words + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if a >= least and len(p) - 1 >= least_words}
    out = []
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and 100 * b >= share * a and any(q[1 + i : 1 + i + len(w)] == w for i in range(len(q) - len(w))) for q, b in cand.items()):
            continue
        score, _, left, right = min((1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    return sorted(out)


def mined(df, **given):
    return sorted(tuple(r[c] for c in ("lang", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(df, **given).collect())


def invented(seed, docs=60):
    r = random.Random(seed)
    words = ["the", "The", "new", "york", "é", "of", "Ünder", "a-b", "x y", "日本", *[f"w{k}" for k in range(12)]]
    out = []
    for k in range(docs):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ". ", "\n", ", ", "!"]) for _ in range(r.randint(0, 150)))
        out.append((k % 50, text.replace("new", "new york city") if k % 3 else text, r.choice(["en", "de", None, "und"])))
    return [*out, (1, None, "en"), (2, "", None), (3, " \n ", "fr"), (4, "alone", "fr")]


@pytest.mark.parametrize("given", [{}, {"most_words": 5, "least": 4}, {"least_words": 3, "most_words": 4, "least": 3, "share": 20}, {"most_words": 2}])
def test_plain_count(spark, given, monkeypatch):
    """Also with small chunks, a split of most prefixes and folds of a few rows."""
    rows = invented(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", word int").repartition(4)
    want = plain(rows, **given)
    assert want
    assert mined(df, **given) == want
    monkeypatch.setattr(collocations, "TOKENS", 37)
    monkeypatch.setattr(collocations, "FOLD", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert mined(df, **given) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_pair_long_text_and_seeds(spark, monkeypatch):
    rows = [(0, "hot pair " * 300_000, "en"), (1, " ".join(f"hot pair v{k % 700}" for k in range(20_000)), "en"), (2, "x" * 5_000_000 + " y " * 20, "en")]
    df = spark.createDataFrame(rows, DOC)
    assert mined(df) == plain(rows)
    real = collocations.hashed
    monkeypatch.setattr(collocations, "hashed", lambda seed, word: real(seed, word) if seed else real(seed, word) % 5)  # the first seed's hashes clash
    assert mined(df) == plain(rows)


def test_empty(spark):
    assert collocations.top(collocations.mine(spark.createDataFrame([], DOC))).collect() == []


def test_decimals(spark):
    """Products beyond 64 bits are exact."""
    a = 3_000_000_019
    r = spark.sql(f"SELECT (cast(1000000 AS decimal(7, 0)) * (cast({a}L AS decimal(19, 0)) * cast({a}L AS decimal(19, 0)))) div (cast({a + 7}L AS decimal(19, 0)) * cast({a + 1}L AS decimal(19, 0))) AS s").head()
    assert r.s == 1000000 * a * a // ((a + 7) * (a + 1))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(queries.oracle_sql()["op12_collocations"])
    cols = [d[0] for d in cur.description]
    want = sorted(tuple(r) for r in cur.fetchall())
    got = queries.op12_collocations(spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert want and mined(spark.createDataFrame(rows, DOC)) == plain(rows)
