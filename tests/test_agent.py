"""The agent's rounds against a plain loop over each question."""

import random
import re

from pyspark.sql import functions as F

from tessella.functions import tables as T
from tessella.operators import agent, endpoints, retrieve

WORDS = "pension transfer withdrawal gratuity notice wage salary tax rent form nominee bonus".split()


def knowledge_base(r):
    out = []
    for k in range(40):
        out.append((f"D{k}" if k != 7 else "", f"S{k % 12}" if k % 3 else None, f"title {k}", r.choice(["pf", "payslip", "tax"]), r.choice(["a", "", None]), None if k % 5 else "2020-01-01", " ".join(r.choice(WORDS) for _ in range(r.randint(5, 90))), k))
    return out


def scripts(r, n):
    """Questions that hold their replies, a round each."""
    def reply():
        search = lambda: f"""Action: SearchKB({(q := r.choice('"' + "'"))}{' '.join(r.sample(WORDS, 2))}{q})"""
        return r.choice([search, search, search, lambda: f'Action: GetPolicy("{r.choice("DS")}{r.randint(0, 45)}")', lambda: "Thought: sum\nAction:  ParsePayslip()", lambda: "Done: enough " + search(), lambda: "no action", lambda: 'Action: GetPolicy("D1") ' + search(),
                         lambda: 'Action: SearchKB("")', lambda: "Action: SearchKB(\"two\nlines\")", lambda: None])()

    return [(k, [reply() for _ in range(3)], r.choice(["pf", "payslip", None]), {"basic_salary": r.choice(["12000", "x", None]), "gross_salary": r.choice(["15000", None]), "epf_deducted": "1440", "state": r.choice(["Karnataka", None, ""])}) for k in range(n)]


def plain(questions, kb, hits, texts):
    docs, sections = {}, {}
    for d in kb:
        docs.setdefault(d[0], d)
        if d[1] is not None:
            sections.setdefault(d[1], d)
    out, turns = [], []
    for qid, replies, domain, _ in questions:
        passages, seen, tools = [], set(), []
        for k, reply in enumerate(replies):
            call = None
            if reply is not None and "Done:" not in reply:
                if m := re.search(r"""Action:\s*SearchKB\(["'](.+?)["']\)""", reply):
                    call = ("SearchKB", m[1])
                elif m := re.search(r"""Action:\s*GetPolicy\(["'](.+?)["']\)""", reply):
                    call = ("GetPolicy", m[1])
                elif re.search(r"Action:\s*ParsePayslip\(\)", reply):
                    call = ("ParsePayslip", None)
            if call is None:
                turns.append((qid, k, reply, None, None, None))
                break
            if call[0] == "SearchKB":
                new = [docs[i] for i in hits.get(call[1], []) if i not in seen]
                seen |= {d[0] for d in new}
                passages += new
                said = "\n---\n".join(f"doc_id={d[0] or '?'} | domain={d[3]} | subdomain={d[4] or '?'}\n{d[6][:300]}" for d in new) or "No new results."
            elif call[0] == "GetPolicy":
                d = docs.get(call[1]) or sections.get(call[1])
                said = "\n".join([f"doc_id: {d[0]}", f"title: {d[2]}", f"domain: {d[3]}", f"effective_date: {d[5]}", "content:", d[6]]) if d else f"[GetPolicy] No document found for '{call[1]}'"
                if d and call[1] not in seen:
                    seen.add(call[1])
                    passages.append(d)
            else:
                said = texts[qid]
                tools.append((T.TOOL_DOC, None, None, "payslip", "tool_output", None, said))
            turns.append((qid, k, reply, *call, said))
        if not passages and not tools:
            passages = [docs[i] for i in hits.get(f"question {qid} pension", [])]
        passages += tools
        passages = [p for p in passages if p[3] == domain] + [p for p in passages if p[3] != domain]
        out += [(qid, n, p[0], p[6]) for n, p in enumerate(passages, 1)]
    return sorted(out), sorted(turns, key=repr)


def test_rounds_against_a_loop(spark):
    r = random.Random(11)
    kb, questions = knowledge_base(r), scripts(r, 120)
    k = spark.createDataFrame(kb, "doc_id string, section_id string, title string, domain string, subdomain string, effective_date string, content string, _ord long")
    q = spark.createDataFrame([(i, f"question {i} pension", d, s) for i, _, d, s in questions], "query_id long, question string, domain string, slots map<string,string>")
    docs = k.select("doc_id", F.col("content").alias("text"))
    search = lambda asked, n: retrieve.bm25(docs, asked, n)
    replies = F.array(*[F.array(*[F.lit(x).cast("string") for x in rep]) for _, rep, _, _ in questions])
    found, turns = agent.gather(q, lambda n: F.get(F.get(replies, F.col("query_id").cast("int")), n), search, k)
    asked = sorted({m for _, rep, _, _ in questions for x in rep if x for m in re.findall(r"""SearchKB\(["'](.+?)["']\)""", x)} | {f"question {i} pension" for i, *_ in questions})
    hits = {}
    for h in search(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), 4).orderBy("query_id", "rank").collect():
        hits.setdefault(asked[h["query_id"]], []).append(h["doc_id"])
    texts = {x["query_id"]: x["text"] for x in agent.payslip_texts(q).collect()}
    want, want_turns = plain(questions, kb, hits, texts)
    assert sorted((x["query_id"], x["place"], x["doc_id"], x["content"]) for x in found.collect()) == want
    assert sorted(((x["query_id"], x["round"], x["reply"], x["tool"], x["argument"], x["observation"]) for x in turns.collect()), key=repr) == want_turns
    assert {t[3] for t in want_turns} == {None, "SearchKB", "GetPolicy", "ParsePayslip"}
    assert any(x["doc_id"] == T.TOOL_DOC and "PAYSLIP AUDIT RESULT" in x["content"] for x in found.collect())


def test_endpoint_as_policy_and_no_questions(spark):
    """A model's column is a policy; stopped questions aren't asked again."""
    k = spark.createDataFrame(knowledge_base(random.Random(1)), "doc_id string, section_id string, title string, domain string, subdomain string, effective_date string, content string, _ord long")
    q = spark.createDataFrame([(1, "pension", "pf", {}), (2, "stop", "pf", {})], "query_id long, question string, domain string, slots map<string,string>")
    search = lambda asked, n: retrieve.bm25(k.select("doc_id", F.col("content").alias("text")), asked, n)
    model = lambda prompts: ["Done:" if "stop" in p else 'Action: SearchKB("pension")' for p in prompts]
    _, turns = agent.gather(q, lambda n: endpoints.column(model, F.concat_ws("|", "question", F.size("turns").cast("string"))), search, k)
    assert sorted((x["query_id"], x["round"]) for x in turns.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    found, turns = agent.gather(q.limit(0), lambda n: F.lit("Done:"), search, k)
    assert found.count() == 0 and turns.count() == 0
