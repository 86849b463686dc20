"""Pages to rows, conditions out of a model's replies, versions of the index, and records with typed metadata."""

import json
import random
import re

from pyspark.sql import functions as F

from tessella.operators import building, endpoints, knowledge, synthesis
from tessella.sources import files


def test_pages_to_rows(spark):
    r = random.Random(3)
    words = "kyc pension claim member complete Form 10C office year".split()
    pages = [(f"/data/in/file {d}.v1.pdf", n, " ".join(r.choice(words) + r.choice(["", "", ".", "\n", "  "]) for _ in range(r.randint(0, 80))) + f"\nPage {n}\n") for d in range(6) for n in range(1, r.randint(2, 9))]
    pages += [("blank.pdf", 1, " \n "), ("none.pdf", 1, None), ("one.pdf", 1, "A claim of less than 5 years, more than 50000. KYC is complete.")]
    got = {}
    for x in building.kb_rows(spark.createDataFrame(pages, "path string, page int, text string").repartition(3), "2026-01-31", 40, 8).collect():
        got.setdefault(x["source_file"], []).append(x)
    assert set(got) == {p for p, _, t in pages if t and t.strip()}
    for path, rows in got.items():
        mine = [(n, t) for p, n, t in pages if p == path]
        text = re.sub(r"Page \d+", "", re.sub(r"\s+", " ", " ".join(t for _, t in mine))).strip()
        low = text.lower()
        domain = next((d for d, w in (("withdrawal", "withdrawal"), ("kyc", "kyc"), ("pension", "pension"), ("tax", "tds")) if w in low), "general")
        title = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
        doc = f"{domain}_2026_{title}"
        rows.sort(key=lambda x: x["chunk_index"])
        assert [(x["content"], x["span_start"]) for x in rows] == knowledge.chunk(text, 40, 8)
        begins = []
        for k in range(len(mine)):  # where a page begins: the length of what is before it, cleaned
            begins.append(len(re.sub(r"Page \d+", "", re.sub(r"\s+", " ", " ".join([*(t for _, t in mine[:k]), ""]))).lstrip()))
        for i, x in enumerate(rows):
            assert (x["doc_id"], x["title"], x["domain"], x["section_id"], x["chunk_id"], x["total_chunks"]) == (doc, title, domain, f"{doc}_S{i}", f"{doc}_chunk_{i}", len(rows))
            assert x["page_numbers"] == [n for n, _ in mine] and x["required_slots"] == [c["field"] for c in x["conditions"]] and x["forms"] == re.findall(r"Form\s?\d+[A-Z]*", x["content"])
            last = max(x["span_start"], x["span_end"] - 1)
            near = [n for (n, _), a, b in zip(mine, begins, [*begins[1:], 10**9]) if a <= last + 2 and b > x["span_start"] - 2]
            sure = [n for (n, _), a, b in zip(mine, begins, [*begins[1:], 10**9]) if a <= last - 2 and b > x["span_start"] + 2]
            assert set(sure) <= set(x["pages_hit"]) <= set(near)
    assert [(c["field"], c["operator"], c["value"]) for c in got["one.pdf"][0]["conditions"]] == [("service_years", "lt", "5"), ("withdrawal_amount", "gt", "50000"), ("kyc_status", "eq", "complete")]


def test_each_prompt_is_sent_once(spark, tmp_path):
    """Also if several questions share a passage; replies of all kinds become conditions or none."""
    replies = {
        "a": '```json\n[{"field": "age", "operator": "gte", "value": 58, "mandatory": true}, {"operator": "eq"}, 7, {"field": "x", "operator": "eq", "value": "y", "doc_id": "OWN"}]\n```', "b": '{"field": "age"}', "c": "no JSON", "d": "[]",
        "e": json.dumps([{"field": f"f{k}", "operator": "gt", "value": 1.5, "mandatory": k % 2 == 0} for k in range(6)]), "f": None, "g": '[{"field": "n", "operator": "not_null", "value": null}]',
    }
    seen = str(tmp_path / "seen")

    def model(prompts):
        with open(seen, "a") as f:
            f.writelines(p.split("\n")[-1][:1] + "\n" for p in prompts)
        if any(p.split("\n")[-1].startswith("z") for p in prompts):
            raise RuntimeError("down")
        return [replies[p.split("\n")[-1][0]] for p in prompts]

    rows = [(q, f"D{c}", f"{c} is a passage of more than twenty characters" + "!" * 700, "pf", "transfer") for q in range(5) for c in replies] + [(1, "Ds", "short", "pf", "transfer"), (1, "Dn", None, None, None)]
    df = spark.createDataFrame(rows, "query_id long, doc_id string, content string, asked string, intent string").repartition(4)
    got = building.model_conditions(df, model, batch=1, tries=2, pause=0.0).collect()
    assert sorted(open(seen).read().split()) == sorted(replies)
    of = {x["doc_id"]: [(c["field"], c["operator"], c["value"], c["mandatory"], c["doc_id"]) for c in x["conditions"]] for x in got}
    assert len(got) == len(rows)
    assert of["Da"] == [("age", "gte", "58", True, "Da"), ("x", "eq", "y", None, "OWN")] and of["Dg"] == [("n", "not_null", None, None, "Dg")]
    assert [c[0] for c in of["De"]] == ["f0", "f1", "f2", "f3"] and all(of[d] == [] for d in ("Db", "Dc", "Dd", "Df", "Ds", "Dn"))
    down = spark.createDataFrame([(1, "Dz", "z" * 50, "pf", "transfer")], df.schema)
    assert building.model_conditions(down, model, tries=1, pause=0.0).first()["conditions"] == []


def test_versions_encode_only_what_is_new(spark, tmp_path):
    path, seen = f"{tmp_path}/index", str(tmp_path / "seen")
    plain = endpoints.hashed_encoder(8)

    def encode(texts):
        with open(seen, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return plain(texts)

    def sent():
        with open(seen) as f:
            out = sorted(f.read().splitlines())
        open(seen, "w").close()
        return out

    kb = lambda rows: spark.createDataFrame(rows, "doc_id string, title string, content string")
    assert building.current(spark, path).count() == 0
    first = building.publish(kb([("1", "t", "one"), ("2", None, "two"), ("3", "", "two"), ("4", "t", None)]), path, encode, 1)
    assert sent() == ["", "t: one", "two"] and first.count() == 4
    second = building.publish(kb([("1", "t", "one"), ("2", None, "changed"), ("5", "t", "one"), ("6", "", "new")]), path, encode, 2)
    assert sent() == ["changed", "new"]
    assert {r["doc_id"]: r["embedding"] for r in second.collect()} == {"1": plain(["t: one"])[0], "2": plain(["changed"])[0], "5": plain(["t: one"])[0], "6": plain(["new"])[0]}
    assert first.count() == 4 and {r["doc_id"] for r in first.collect()} == {"1", "2", "3", "4"}  # readers of the first go on
    (tmp_path / "index" / "batch=000000000002" / "_SUCCESS").unlink()  # a build that was lost at its end
    assert {r["doc_id"] for r in building.current(spark, path).collect()} == {"1", "2", "3", "4"}
    building.publish(kb([("2", None, "changed")]), path, encode, 2)
    assert sent() == ["changed"] and [r["doc_id"] for r in building.current(spark, path).collect()] == ["2"] and len(building.versions(spark, path)) == 2


def test_records_keep_types_through_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p" * 2000, "c", "r", 12000, None, True, 7.5, "Goa"), (2, 'q"\n', "é", "r", None, 3, None, None, None)], "id long, full_prompt string, chosen string, rejected string, basic_salary long, years int, pregnant boolean, rate double, state string")
    made = synthesis.records(rows, {n: F.col(n) for n in ("basic_salary", "years", "pregnant", "rate", "state")}, domain=F.lit("pf"), ids=F.array(F.lit("A"), F.lit("B")), n=F.col("id"))
    files.write_json_lines(made, f"{tmp_path}/r")
    lines = [json.loads(x["value"]) for x in spark.read.text(f"{tmp_path}/r").collect()]
    lines.sort(key=lambda x: x["metadata"]["n"])
    assert lines[0]["metadata"] == {"domain": "pf", "ids": ["A", "B"], "n": 1, "slots": {"basic_salary": 12000, "pregnant": True, "rate": 7.5, "state": "Goa"}} and lines[1]["metadata"]["slots"] == {"years": 3}
    assert lines[0]["prompt"] == "p" * 1500 and lines[0]["full_prompt"] == "p" * 2000 and lines[1]["full_prompt"] == 'q"\n'
    back = spark.read.text(f"{tmp_path}/r").select(synthesis.read_record(F.col("value")).alias("r")).select("r.*")
    get = lambda p, t: F.try_variant_get("metadata", p, t)
    got = back.select(get("$.n", "long").alias("n"), get("$.slots.basic_salary", "long"), get("$.slots.pregnant", "boolean"), get("$.slots.rate", "double"), get("$.slots.state", "string"), get("$.slots.years", "int"), get("$.ids[1]", "string"), "chosen").orderBy("n").collect()
    assert [tuple(x) for x in got] == [(1, 12000, True, 7.5, "Goa", None, "B", "c"), (2, None, None, None, None, 3, "B", "é")]


def test_pages_of_a_long_document_are_placed_in_one_pass(spark):
    """A document of 3000 pages; each page's place was found by cleaning the whole document again."""
    import time

    p = spark.createDataFrame([("d.pdf", k + 1, f"page text  number {k} of many\n") for k in range(3000)], "path string, page int, text string")
    began = time.time()
    rows = building.kb_rows(p, "2026-01-31").select("span_start", "pages_hit").orderBy("span_start").collect()
    assert max((r["pages_hit"] for r in rows), key=len) == list(range(1, 3001)) and time.time() - began < 60
