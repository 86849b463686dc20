"""Steps of generation on small tables: budgets against a loop, choices, tools, reuse, and empty inputs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.functions import rules
from tessella.operators import endpoints, generation, knowledge, retrieve, storage
from tessella.sources import files


def test_budget_against_a_loop(spark):
    import random

    r = random.Random(3)
    rows = [(d, r.randint(0, 3), n, r.random() < 0.6) for n in range(9000) for d in "ab"]
    done = {("a", 0): 5, ("a", 1): 9, ("b", 3): 40}
    kept, total, per, tries = set(), Counter({"a": 14, "b": 40}), Counter(done), Counter()
    begun = dict(total)
    for d, s, n, ok in rows:
        if tries[d] < 3 * (60 - begun[d]):
            tries[d] += 1
            if ok and per[d, s] < 20 and total[d] < 60:
                per[d, s] += 1
                total[d] += 1
                kept.add((d, n))
    df = spark.createDataFrame(rows, "domain string, subdomain int, attempt long, accepted boolean")
    log = spark.createDataFrame([(d, s, n) for (d, s), n in done.items()], "domain string, subdomain int, n long")
    assert {(x["domain"], x["attempt"]) for x in generation.budgeted(df, 60, 20, done=log).collect()} == kept
    assert generation.budgeted(df.limit(0), 60, 20).count() == 0
    assert generation.budgeted(df, 60, 20).groupBy("domain").count().where("count = 60").count() == 2


def test_passages_are_distinct_and_cross_documents_exist(spark):
    docs = spark.createDataFrame([(i, "d", "s" if i < 40 else "t" if i < 42 else "u") for i in range(43)], "doc_id long, domain string, subdomain string")
    asked = spark.createDataFrame([(i, "d", "stux"[i % 4], [41, 999]) for i in range(200)], "id long, domain string, subdomain string, cross array<bigint>")
    got = {r["id"]: r["picked"] for r in generation.chosen_passages(asked, docs).collect()}
    assert set(got) == {i for i in range(200) if i % 4 != 3}  # no documents, no choice
    for i, p in got.items():
        assert len(p) == len(set(p)) and 41 in p and 999 not in p and len(p) <= 4
        assert i % 4 != 1 or sorted(p) == [40, 41]


def test_tools_and_fallback(spark):
    hit = "query_id long, rank int, doc_id string, domain string, subdomain string, effective_date string, content string"
    found, fallback = spark.createDataFrame([(1, 1, "A", "pf", "x", None, "a")], hit), spark.createDataFrame([(n, 1, "F", "pf", "x", None, "f") for n in (1, 2, 3)], hit)
    tools = generation.tool_passage(spark.createDataFrame([(1, "audit"), (2, "audit")], "query_id long, text string"))
    assert {r["content"] for r in tools.collect()} == {"audit"}
    got = sorted((r["query_id"], r["rank"] > 1 << 29, r["doc_id"]) for r in generation.with_tools(found, tools, fallback).collect())
    assert got == [(1, False, "A"), (1, True, "TOOL_PAYSLIP_AUDIT"), (2, True, "TOOL_PAYSLIP_AUDIT"), (3, False, "F")]


def test_reuse_takes_the_last_row_with_a_response(spark):
    accepted = spark.createDataFrame([("i", "k", "one", 1), ("i", "k", "two", 2), ("i", "k", None, 3), ("i", None, "null", 4)], "intent string, slot_key string, response string, _ord long")
    asked = spark.createDataFrame([(1, "i", "k", "t"), (2, "j", "k", "t"), (3, "i", None, "t")], "id long, intent string, slot_key string, template string")
    assert {r["id"]: (r["answer"], r["source"]) for r in generation.reused(asked, accepted).collect()} == {1: ("two", "reuse"), 2: ("t", "template"), 3: ("t", "template")}


def test_indented_json_and_audit_text(spark):
    row = spark.range(1).select(generation.json_indented(F.create_map(F.lit("a"), F.lit('x"y'), F.lit("b"), F.lit(None).cast("string"))).alias("j"), generation.json_indented(F.create_map(F.lit("a"), F.lit(None).cast("string"))).alias("e"),
                                rules.audit_text(F.lit(12000), F.lit(0), F.lit("Goa"), F.array(F.struct(F.lit("EPF").alias("kind"), F.lit(1440).alias("expected"), F.lit("CORRECT").alias("verdict")))).alias("t")).first()
    assert row["j"] == '{\n  "a": "x\\"y"\n}' and row["e"] == "{}"
    assert "Basic Salary: ₹12,000" in row["t"] and "Gross Salary: not provided" in row["t"] and "Expected: 1,440" in row["t"]


def test_chunk_rows_and_judge(spark):
    c = spark.createDataFrame([(7, 0, 1, "x")], "doc_id long, chunk_index int, total_chunks int, content string")
    r = knowledge.chunk_rows(c, "pf", 2024).first()
    assert (r["doc_id"], r["section_id"], r["chunk_id"]) == ("pf_2024_7", "pf_2024_7_S0", "pf_2024_7_chunk_0")
    got = spark.createDataFrame([("the rate is 12", "the rate is 12 percent"), ("nothing alike", "the rate")], "a string, s string").select(endpoints.overlap_judge(F.col("a"), F.col("s")).alias("n")).collect()
    assert [x["n"] for x in got] == [5, 1]


def test_json_array_and_vectors_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, t string")
    files.write_json_array(d, f"{tmp_path}/a", "id")
    import glob
    import json

    with open(glob.glob(f"{tmp_path}/a/part-*")[0]) as f:
        assert json.load(f) == [{"id": i, "t": f"t{i}"} for i in range(20)]
    assert files.json_array(spark, f"{tmp_path}/a", "id long, t string").count() == 20
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    files.write_vectors(v, f"{tmp_path}/v", 2)
    assert [r["vec_id"] for r in files.read_vectors(spark, f"{tmp_path}/v").collect()] == [1]


def test_pages_from_a_folder(spark, tmp_path):
    import hashlib

    from tessella.sources import http

    (tmp_path / hashlib.md5(b"http://a/").hexdigest()).write_text("<p>é</p>")
    http.register(spark)
    got = {r["url"]: (r["html"], r["error"] is None) for r in spark.read.format("pages").option("urls", "http://a/\nhttp://b/").option("folder", str(tmp_path)).load().collect()}
    assert got == {"http://a/": ("<p>é</p>", True), "http://b/": (None, False)}


def test_bm25_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a word"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert retrieve.bm25(d.limit(0), q, 3).count() == retrieve.bm25(d, q.limit(0), 3).count() == 0
    assert [r["doc_id"] for r in retrieve.bm25(d, q, 3, positive_only=False).collect()] == [1]


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Conf(dict):
        pass

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())
