"""Retrieval, knowledge base, metrics, training data, sources and streams on small cases."""

import json
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessella.functions import tables as T
from tessella.operators import conversation, endpoints, knowledge, metrics, retrieve, synthesis
from tessella.plans import base, slots, training
from tessella.sources import files, html
from tessella.streaming import state

SF = "/root/testdata/sf0.001"


def test_bm25_by_hand(spark):
    docs = {1: "apple pear apple", 2: "pear plum", 3: "fig", 4: "fig date", 5: None}
    d, q = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(1, "apple pear zzz"), (2, None)], "query_id long, text string")
    got = {r["doc_id"]: r["score"] for r in retrieve.bm25(d, q, 4).collect()}
    tokens = {i: (t or "").split() for i, t in docs.items()}
    mean = sum(map(len, tokens.values())) / 5
    idf = lambda w: math.log(5 - (n := sum(w in t for t in tokens.values())) + 0.5) - math.log(n + 0.5)
    want = {i: sum(idf(w) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ("apple", "pear")) for i, t in tokens.items()}
    assert got == {i: round(s, 6) for i, s in want.items() if s > 0}


def test_knn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    monkeypatch.setattr(retrieve, "TILE", 11)
    r = random.Random(1)
    v = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(90)] + [(200, None)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = [(x["query_id"], x["rank"], x["vec_id"]) for x in retrieve.knn(df, df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 3).collect()]
    want = []
    for q, a in v[:-1]:
        if q % 5 == 0:
            near = sorted((sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), i) for i, b in v[:-1])[:3]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    assert sorted(got) == sorted(want)


def test_knn_copies(spark):
    """More copies of one embedding, or equal scores after rounding, than any fixed number of candidates: the smallest ids come."""
    r = random.Random(2)
    v = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(i, [1.0 + r.random() * 1e-5, 2.0, 4.0]) for i in range(200, 400)]
    r.shuffle(v)
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 4.0]), (3, [1000.0, 2000.0, 3000.0])], "query_id long, embedding array<float>")
    got = {(x["query_id"], x["rank"]): x["vec_id"] for x in retrieve.knn(df, q, 5).collect()}
    assert [got[1, k] for k in range(1, 6)] == [0, 1, 2, 3, 4] and [got[2, k] for k in range(1, 6)] == [200, 201, 202, 203, 204]
    far = sorted((round(sum((x - y) ** 2 for x, y in zip((1000.0, 2000.0, 3000.0), e, strict=True)), 6), i) for i, e in ((x["vec_id"], x["embedding"]) for x in df.collect()))
    assert [got[3, k] for k in range(1, 6)] == [i for _, i in far[:5]]
    assert retrieve.knn(df, q, 500).count() == 1200


def test_supersession_chain(spark):
    h = spark.createDataFrame([(1, "A", "B", 1), (1, "B", "C", 2), (1, "C", "", 3), (1, "D", None, 4), (1, "E", "E", 5), (2, "B", None, 1)], "query_id long, doc_id string, supersedes string, rank int")
    assert sorted((r["query_id"], r["doc_id"]) for r in retrieve.not_superseded(h).collect()) == [(1, "A"), (1, "D"), (2, "B")]


def test_retrieval_quality(spark):
    f = spark.createDataFrame([("a", ["x", "y"], ["z", "x"]), ("a", ["q"], ["z"]), ("b", [], ["z"])], "group string, gold array<string>, retrieved array<string>")
    assert {(r["group"], r["n"], r["recall"], r["mrr"]) for r in retrieve.quality(f).collect()} == {("a", 2, 0.25, 0.25), (None, 2, 0.25, 0.25)}


def test_merge_and_lookup(spark):
    one = lambda rows: spark.createDataFrame(rows, "k string, v string, _line long")
    got = knowledge.merge([one([("a", "1", 2), ("a", "0", 1)]), one([("a", "9", 1), ("b", "2", 5)])], "k")
    assert sorted((r["k"], r["v"]) for r in got.collect()) == [("a", "0"), ("b", "2")]
    p = spark.createDataFrame([("D1", "S1", "first", 1), ("D1", "S2", "second", 2), (None, "S3", "third", 3)], "doc_id string, section_id string, content string, _ord long")
    a = spark.createDataFrame([("D1",), ("S2",), ("S3",), ("no",)], "identifier string")
    assert {r["identifier"]: r["content"] for r in knowledge.look_up(a, p).collect()} == {"D1": "first", "S2": "second", "S3": "third", "no": None}
    prompts = spark.createDataFrame([(1, ["D1", "no", "D1"])], "id int, passage_doc_ids array<string>")
    pol = p.where("_ord = 1").select("doc_id", "content")
    assert [x["content"] for x in knowledge.resolve(prompts, pol).first()["passages"]] == ["first", "first"]
    assert [x["content"] for x in knowledge.resolve(prompts, pol, True).first()["passages"]] == ["first", "[passage unavailable]", "first"]
    assert [tuple(r) for r in knowledge.unknown_ids(prompts, pol).collect()] == [("no", 1)]


def test_classification(spark):
    d = spark.createDataFrame([("pf", "pf"), ("pf", "tax"), ("tax", "tax"), ("labour", "pf")], "expected string, predicted string")
    got = {r["class"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.per_class(d).collect()}
    assert got == {"pf": (0.5, 0.5, 0.5), "tax": (0.5, 1.0, 0.666667), "labour": (0.0, 0.0, 0.0)}
    rows = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 1.0), ("n", "a", 0.1), ("n", "b", 0.2), ("n", "c", 0.2)], "metric string, system string, value double")
    assert {r["metric"]: r["winner"] for r in metrics.winner(rows, "a").collect()} == {"m": "a", "n": "b"}


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") < 15, "tiny").otherwise(None).alias("s"))
    runs = [{r["id"]: r["split"] for r in synthesis.split(d, "s", "id", 0.1, 10).collect()} for d in (df, df.repartition(7))]
    n = {r["s"]: r["n"] for r in df.groupBy("s").agg(F.count("*").alias("n")).collect()}
    val = {r["s"]: r["n"] for r in synthesis.split(df, "s", "id", 0.1, 10).where("split = 'val'").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert runs[0] == runs[1] and val == {s: max(1, k // 10) for s, k in n.items() if k >= 10}


def test_breaker(spark):
    rows = [("a", i, i % 2 == 0) for i in range(100)] + [("b", i, i % 5 == 0) for i in range(5000)]
    got = {r["g"]: r["stopped_at"] for r in synthesis.breaker(spark.createDataFrame(rows, "g string, i long, rejected boolean"), "g", "i").collect()}
    assert got == {"a": 50, "b": None}


def test_contrastive(spark):
    long = "\n".join(f"line {k}" for k in range(8))
    data = [(k, f"You are eligible [A_1] by the 5-year rule [B_2].\n{long}", ["A_1", "B_2", T.TOOL_DOC]) for k in range(20)] + [(50, "short [A_1]", ["A_1"])]
    df = spark.createDataFrame(data, "id long, t string, allowed array<string>")
    out = df.select("id", "t", "allowed", synthesis.permute_citations(F.col("t"), F.col("allowed"), F.col("id")).alias("p"), synthesis.flip_verdict(F.col("t"), F.col("id")).alias("f"), synthesis.inject_rule(F.col("t"), F.col("allowed"), F.col("id")).alias("g")).collect()
    for r in out:
        if r["id"] == 50:
            assert r["p"] is None and r["g"].startswith("short [A_1]\n\n**")
            continue
        assert "[B_2] by" in r["p"] and "rule [A_1]." in r["p"]
        assert "Not eligible" in r["f"] and "5-year" not in r["f"] and r["g"].split("\n")[:5] == r["t"].split("\n")[:5] and len(r["g"]) > len(r["t"])
    v = df.select(synthesis.rejected_reason(F.lit("w " * 50 + "eligible [A_1]"), F.lit("w " * 50 + "not eligible [A_1]"), F.lit("verdict_correctness")).alias("v")).first()["v"]
    assert v == "ok"


def test_pairs_are_dealt_by_rows_and_read_each_answer_once(spark, tmp_path, monkeypatch):
    """Customers in one row group are worked on in partitions of bounded rows, and a validator lower-cases and splits an answer once, not once a test."""
    spark.range(1000).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(base, "SPREAD_ROWS", 100)
    for q in (training.contrastive_pairs, training.intent_answers):
        rows = q(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() == 10 and rows.count() == rows.select("id").distinct().count() == 1000
    rows, c = spark.createDataFrame([(1, "a", "b", ["A_1"])], "id long, a string, b string, allowed array<string>"), F.col
    for reason, times in ((synthesis.sft_reason(c("a"), c("allowed")), 1), (synthesis.chosen_reason(c("a"), c("allowed"), F.lit("grounding")), 1), (synthesis.rejected_reason(c("b"), c("a"), F.lit("verdict_correctness")), 2)):
        plan = rows.select(reason.alias("r"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("lower(") == times and plan.count("split(") == plan.count("regexp_extract_all(") == 1


def test_html_rows():
    page = "<table><tr><th>q</th></tr><tr><td> A <b>b</b></td><td>x&amp;y<td>z</tr><tr><td></td><td>n</td></tr></table><ul><li>one<ul><li>two</li></ul></li><li> </li></ul>"
    got = list(html.entries(page, True))
    assert [c for k, _, _, c in html.entries(page, True, once=True) if k == "item"] == ["one two", "two"]
    assert [(k, t, c) for k, _, t, c in got] == [("row", "A b", "x&y"), ("item", html.ITEM_TITLE, "one two"), ("item", html.ITEM_TITLE, "two"), ("item", html.ITEM_TITLE, "two")]
    assert [n for _, n, _, _ in got] == list(range(4)) and list(html.entries(None, True)) == [] and list(html.entries("<div>" * 5000, True)) == []


def test_files(spark, tmp_path):
    src = tmp_path / "in.jsonl"
    src.write_text('{"doc_id": "a", "title": "é"}\n\nnot json\n{"doc_id": "b"}\n', encoding="utf-8")
    df = files.json_lines(spark, str(src), "doc_id string, title string")
    assert sorted(r["doc_id"] for r in df.collect()) == ["a", "b"]
    for ascii_only in (False, True):
        out = str(tmp_path / f"out{ascii_only}")
        files.write_json_lines(df.select("doc_id", "title").where("doc_id = 'a'"), out, ascii_only)
        line = next(r["value"] for r in spark.read.text(out).collect())
        assert json.loads(line) == {"doc_id": "a", "title": "é"} and line.isascii() == ascii_only
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert files.append_once(rows, "id", log).count() == 2 and files.append_once(rows, "id", log).count() == 0 and spark.read.parquet(log).count() == 2
    good, bad = files.split_accepted(rows, F.when(F.col("id") == 1, "ok").otherwise("too short"))
    assert good.count() == 1 and bad.first()["reason"] == "too short"
    stats = {(r["key"], r["value"]): r["n"] for r in files.statistics(rows, "id").collect()}
    assert stats == {("id", "1"): 1, ("id", "2"): 1, ("all", None): 2}
    assert "| 1 |" in files.markdown(rows, "t")
    (tmp_path / "x.pdf").write_bytes(b"fake")
    pages = files.pdf_pages(spark, str(tmp_path), lambda b: [("short", "the longer reading"), ("p" * 60, "")]).orderBy("page").collect()
    assert [(r["text"][:5], r["start"], r["end"]) for r in pages] == [("the l", 0, 18), ("ppppp", 18, 78)]


def test_html_of_any_depth_and_reference():
    """Pages of several MB that nest deeply or hold very long references are read in seconds."""
    import time

    began = time.time()
    assert list(html.entries("<div>" * 300_000 + "<ul><li>x</ul>", True)) == [("item", 0, html.ITEM_TITLE, "x")]
    assert list(html.entries("<table>" + "<tr><td>" * 100_000, True)) == []
    assert len(list(html.entries("<ul><li>a" * 2000, True, once=True))) == 2000
    for ref, want in (("&#" + "9" * 5_000_000 + ";", "\ufffd"), ("&#" + "0" * 5_000_000 + "65;", "A"), ("&#x" + "f" * 5000 + ";", "\ufffd"), ("&#00000000065;", "A"), ("&#12345678", "\ufffd"), ("&#0000000128512;", "😀"), ("&#000000000", "\ufffd")):
        assert [c for *_, c in html.entries(f"<ul><li>{ref}</li></ul>", True)] == [want], ref[:40]
    assert time.time() - began < 60


def test_endpoints(spark):
    calls = []

    def flaky(prompts):
        calls.append(1)
        raise RuntimeError

    df = spark.createDataFrame([("doc_id=X |",), (None,)], "p string")
    assert [r[0] for r in df.select(endpoints.column(endpoints.echo_generator, F.col("p"))).collect()] == ["**Result:** according to the sources [X].", None]
    assert df.select(endpoints.column(flaky, F.col("p"), pause=0.0).alias("a")).first()["a"] == endpoints.FAILED
    v = endpoints.hashed_encoder(8)(["a b", ""])
    assert abs(sum(x * x for x in v[0]) - 1) < 1e-9 and v[1] == [0.0] * 8


def test_conversation_state(spark):
    rows = [(1, 1, "pf", "i1", None, "3"), (1, 2, "pf", "i2", "retired", None), (1, 3, "tax", None, None, None), (1, 4, "tax", "i4", None, "9"), (2, 1, "pf", None, "x", None)]
    t = spark.createDataFrame(rows, "session long, turn long, domain string, intent string, employment_status string, service_years string")
    got = [tuple(r) for r in conversation.merged(t, "session", "turn", ["intent", "employment_status", "service_years"]).select("intent", "employment_status", "service_years").orderBy("session", "turn").collect()]
    assert got == [("i1", None, "3"), ("i1", "retired", "3"), (None, None, None), ("i4", None, "9"), (None, "x", None)]


def test_stream_equals_batch(spark):
    batch = sorted(map(tuple, slots.slot_merge_turns(spark, SF).collect()), key=str)
    stream = sorted(map(tuple, slots.stream_slot_state(spark, SF).collect()), key=str)
    assert batch == stream and batch


def test_event_windows_as_streams(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    src = spark.readStream.schema(e.schema).parquet(f"{SF}/events.parque[t]")
    dedup = state.run_once(spark, state.deduplicated(src, "1 hour", ["event_id"]), base.shared_dir(spark))
    assert dedup.count() == e.select("event_id").distinct().count()
    assert state.windowed(e, "1 day").agg(F.sum("n")).first()[0] == e.count() == state.sessions(e, "6 hours").agg(F.sum("n")).first()[0]


def test_answers_of_all_intents_pass_the_validator(spark):
    """Every intent and verdict is made, and is accepted as a chosen answer; slots of other intents are null."""
    from tessella.functions import answers

    rows = synthesis.intent_slots(spark.range(4000), "id").withColumn("allowed", F.array(F.lit("DOC_1"), F.lit("DOC_2")))
    made = synthesis.intent_answers(rows).withColumn("reason", synthesis.chosen_reason(F.col("chosen"), F.col("allowed"), F.lit("grounding")))
    got = {(r["intent"], r["verdict"]): r["reasons"] for r in made.groupBy("intent", "verdict").agg(F.collect_set(F.coalesce("reason", F.lit("null"))).alias("reasons")).collect()}
    assert set(got) == set(answers.SAYS) and all(v == ["ok"] for v in got.values()), got
    assert made.where("chosen LIKE '%{%' OR chosen IS NULL").count() == 0
    assert made.where("intent = 'gratuity' AND (basic_salary IS NOT NULL OR kyc_status IS NOT NULL)").count() == 0
    one = made.where("intent = 'gratuity' AND verdict = 'due'").first()
    assert one["amount"] == one["last_drawn_salary"] * 15 * one["employment_years"] // 26


def test_refusals_pass_the_validator(spark):
    q = spark.createDataFrame([(k, ["can I sue?", "visa", "weather", ""][k % 4], ["pf", "payslip", "labour", "tax", None][k % 5], ["A_1"]) for k in range(400)], "id long, question string, domain string, allowed array<string>")
    got = synthesis.refusal_pairs(q).collect()
    assert {r["reason"] for r in got} == {"ok"} and {r["kind"] for r in got} == {"out_of_scope", "not_covered"}
    assert 0.2 < sum(r["kind"] == "out_of_scope" for r in got) / len(got) < 0.4 and all("{" not in r["chosen"] + r["rejected"] for r in got)


def test_bm25_in_passes_and_blocks(spark, monkeypatch):
    """Many queries: the same hits in several passes and blocks, and no documents times queries are joined or exchanged."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = [(i, " ".join(r.choices(words, weights=range(1, 41), k=r.randint(1, 30)))) for i in range(300)]
    docs += [(i + 1000, t) for i, t in docs[:50]]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([(i, " ".join(r.choices([*words, "none"], k=r.randint(0, 6)))) for i in range(60)], "query_id long, text string")
    run = lambda: retrieve.bm25(d, q, 4, positive_only=False)
    whole = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(retrieve, "SENT_WEIGHTS", 50)
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    made = run()
    assert sorted(map(tuple, made.collect())) == whole
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(doc_id" not in plan
    tokens = {i: t.split() for i, t in docs}
    mean, n = sum(map(len, tokens.values())) / len(tokens), len(tokens)
    idf = {w: math.log(n - (k := sum(w in t for t in tokens.values())) + 0.5) - math.log(k + 0.5) for w in words}
    low = sum(idf.values()) / len(idf) * 0.25
    idf = {w: low if x < 0 else x for w, x in idf.items()}
    want = []
    for i, text in q.collect():
        score = {j: round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in text.split() if w in t), 6) for j, t in tokens.items() if set(text.split()) & set(t)}
        want += [(i, j, k + 1, score[j]) for k, j in enumerate(sorted(score, key=lambda j: (-score[j], j))[:4])]
    assert whole == sorted(want)


def test_bm25_sums_few_cells_in_double_precision(monkeypatch):
    """Cells are ruled out in single precision, and hits are still exact: scores that single precision can't tell apart, ties, negative weights and documents that share no token."""
    r = np.random.default_rng(5)
    for least, copies, words in ((0.5, 1, 40), (-0.5, 1, 1), (0.5, 40, 1)):
        docs = [r.zipf(1.3, r.integers(words, 100)) % 500 for _ in range(6000 // copies)] * copies + [np.zeros(0, np.int64), np.full(3, 10**6)]
        queries = [np.unique(r.zipf(1.2, r.integers(words, words + 20)) % 600) for _ in range(300)]
        q, t = np.repeat(np.arange(300), [len(x) for x in queries]), np.concatenate(queries)
        vocabulary, place = np.unique(t, return_inverse=True)
        weight = r.integers(least * 2, 9, len(q)) + 1.0 + r.integers(0, 3, len(q)) * 1e-6
        cells = {np.float32: 0, np.float64: 0}
        products, sums = retrieve._products, retrieve._sums

        def counted(*a, products=products, cells=cells):
            made = products(*a)
            cells[made.dtype.type] += made.size
            return made

        def summed(*a, sums=sums, cells=cells):
            made = sums(*a)
            cells[np.float64] += len(made)
            return made

        monkeypatch.setattr(retrieve, "_products", counted)
        monkeypatch.setattr(retrieve, "_sums", summed)
        batch = pa.record_batch([pa.array(range(len(docs))), pa.array(docs, pa.list_(pa.int64()))], names=["doc_id", "codes"])
        (out,) = retrieve._best_documents(iter([batch]), (pa.array(range(300)), q, place, weight, vocabulary), 4, 1.5, 0.75, 30.0, 6, 64, 2048)
        monkeypatch.undo()
        got = {}
        for x in out.to_pylist():
            got.setdefault(x["query_id"], []).append((-x["score"], x["doc_id"]))
        tf = np.array([np.bincount(d[d < 600], minlength=600) for d in docs])
        share = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * np.array([len(d) for d in docs])[:, None] / 30.0))
        for k in range(300):
            cost = np.round(-(share[:, t[q == k]] @ weight[q == k]), 6)
            met = np.flatnonzero((tf[:, t[q == k]] > 0).any(axis=1))
            want = sorted(zip(cost[met], met, strict=True))[:4]
            assert [i for _, i in sorted(got.get(k, []))] == [i for _, i in want] and np.allclose([c for c, _ in sorted(got.get(k, []))], [c for c, _ in want], atol=1.1e-6)
        assert words == 1 or cells[np.float64] < cells[np.float32] / 10


def test_rag_pipeline_asks_for_slots_of_every_domain(spark, tmp_path):
    """Slots are those of the item's own domain, so the gate asks back outside pf too, and what passes it is reasoned about."""
    items = {1: "Is ESI right on my pay slip?", 2: "80C investment of 2 lakh", 3: "80C investment of 2 lakh under the new regime", 4: "Gratuity please, my employer doesn't pay", 5: "Gratuity after I worked 7 years with salary of 30,000?", 6: "the", 7: None}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(t or "" for t in items.values())
    spark.createDataFrame([(k, text + " x" * k, "s", "en") for k in range(1, 10)] + [(k, f"none w{k}", "s", "en") for k in range(10, 40)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["query_id"]: r for r in training.rag_pipeline(spark, str(tmp_path)).collect()}
    assert {k: r["domain"] for k, r in got.items()} == {1: "payslip", 2: "tax", 3: "tax", 4: "labour", 5: "labour", 6: "pf", 7: "pf"}
    for k, slot in ((1, "gross_salary"), (2, "tax_regime"), (4, "employment_years")):
        assert (got[k]["decision"], got[k]["answer"], got[k]["cited"], got[k]["made_up"]) == ("ASK", T.GATE_QUESTIONS[slot], 0, 0)
    assert got[6]["decision"] == "ANSWER" and got[6]["cited"] == 4 and got[7]["answer"] == "**Result:** no source covers this; please escalate." and all(r["made_up"] == 0 for r in got.values())
    # The gate has nothing to ask of these, but the conditions of their passages are open.
    for k, slot in ((3, "tax_regime"), (5, "employment_years")):
        assert got[k]["decision"] == "ASK" and got[k]["answer"].endswith("?") and got[k]["answer"] != T.GATE_QUESTIONS[slot]


def test_knn_in_passes(spark, monkeypatch):
    """Queries in several passes give the same hits, and no vectors are packed or joined with queries."""
    r = random.Random(4)
    df = spark.createDataFrame([(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(90)], "vec_id long, embedding array<float>")
    run = lambda: retrieve.knn(df, df.withColumnRenamed("vec_id", "query_id"), 3)
    whole = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(retrieve, "SENT_NUMBERS", 100)
    made = run()
    assert sorted(map(tuple, made.collect())) == whole and len(whole) == 270
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def test_plan_of_changed_verdicts_is_small(spark):
    """The question is in the plan a few times, not once for each keyword of the router."""
    plan = training.fixed_broken(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000 and plan.count("Kochi in Kerala") <= 2


def test_searches_of_an_index_count_the_documents_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(retrieve, "cut", lambda df, label, real=retrieve.cut: made.append(label) or real(df, label))
    d = spark.createDataFrame([(1, "apple pear apple"), (2, "pear plum"), (3, "fig"), (4, "fig date"), (5, None)], "doc_id long, text string")
    asked = [spark.createDataFrame([(1, t)], "query_id long, text string") for t in ("apple pear", "fig", "none")]
    index = retrieve.indexed(d)
    got = [retrieve.bm25(index, q, 2).collect() for q in asked]
    assert made.count("document-frequencies") == made.count("document-codes") == 1
    assert got == [retrieve.bm25(d, q, 2).collect() for q in asked] and list(map(len, got)) == [2, 2, 0]


def test_pairs_are_counted_without_a_filter_on_their_text(spark):
    """A filter on the answer would bring the slots' expressions, many times over, down to the table."""
    made = training.pair_statistics(spark, SF)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and {r["intent"] for r in made.collect()} == {None, "verify_epf", "verify_esi", "full_audit"}
