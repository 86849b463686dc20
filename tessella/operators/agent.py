"""An agent that gathers passages in rounds of one tool call each, over all questions at once.

A policy gives each open question's reply out of the question and its turns so far: a Column, or an endpoint's column. A reply that says it is done, names no
tool, or is missing (the call failed) ends its question. The others' actions are dispatched by joins: SearchKB to a retriever, GetPolicy to the policy table,
ParsePayslip to the rules over the question's slots. A round's state, a row a question, is written to the shared folder; questions that stop leave the next round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions import tables as T
from tessella.operators import generation, retrieve
from tessella.operators.storage import cut

ROUNDS, HITS = 3, 4
#: Content that an observation shows of a passage.
SHOWN = 300
NONE_NEW = "No new results."
TURNS = "array<struct<reply:string,observation:string>>"
PASSAGE = ("query_id", "rank", "doc_id", "domain", "subdomain", "effective_date", "content")

Search = Callable[[DataFrame, int], DataFrame]


def parsed_action(reply: Column) -> Column:
    """(tool, argument) of the first kind of call that a reply has, in the order SearchKB, GetPolicy, ParsePayslip; null for none or where it says it is done."""
    argument = lambda tool: F.regexp_extract(reply, rf"""(?d)Action:\s*{tool}\(["'](.+?)["']\)""", 1)
    call = lambda tool, value: F.struct(F.lit(tool).alias("tool"), value.alias("argument"))
    named = F.when(argument("SearchKB") != "", call("SearchKB", argument("SearchKB"))).when(argument("GetPolicy") != "", call("GetPolicy", argument("GetPolicy")))
    return F.when(~F.contains(reply, F.lit("Done:")), named.when(reply.rlike(r"Action:\s*ParsePayslip\(\)"), call("ParsePayslip", F.lit(None).cast("string"))))


def payslip_texts(asked: DataFrame) -> DataFrame:
    """(query_id, text): the audit of every question's slots (a string map)."""
    number = lambda name: F.try_element_at("slots", F.lit(name)).try_cast("long").alias(name)
    s = asked.select("query_id", *[number(n) for n in ("basic_salary", "gross_salary", "epf_deducted", "esi_deducted")], F.try_element_at("slots", F.lit("state")).alias("state"))
    place = F.when(F.col("kind") == "EPF", 0).when(F.col("kind") == "ESI", 1).otherwise(2)
    rows = R.audit(s).groupBy(F.col("query_id").alias("_q")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "kind", "expected", "verdict"))).alias("d"))  # three at most
    none = F.array().cast("array<struct<place:int,kind:string,expected:bigint,verdict:string>>")
    return s.join(rows, F.col("query_id") == F.col("_q"), "left").select("query_id", R.audit_text(F.col("basic_salary"), F.col("gross_salary"), F.col("state"), F.coalesce("d", none)).alias("text"))


def _said(rows: DataFrame) -> DataFrame:
    """(query_id, observation) of a search's new passages, as many as a search gives at most."""
    show = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    text = F.concat(F.lit("doc_id="), show("doc_id"), F.lit(" | domain="), show("domain"), F.lit(" | subdomain="), show("subdomain"), F.lit("\n"), F.left(F.coalesce("content", F.lit("")), F.lit(SHOWN)))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))).alias("x"))
    return listed.select("query_id", F.array_join("x.text", "\n---\n").alias("observation"))


def gather(questions: DataFrame, policy: Callable[[int], Column], search: Search, kb: DataFrame, rounds: int = ROUNDS, hits: int = HITS) -> tuple[DataFrame, DataFrame]:
    """(passages, turns) of questions (query_id, question, domain, slots: a string map).

    passages: PASSAGE and `place`, own domain first, otherwise in order of arrival with tools' outputs behind; a question for which nothing came in has a search of its own text. turns: (query_id, round,
    reply, tool, argument, observation), without tool and observation where the question stopped.
    policy(round) is a Column over questions' columns and `turns` (TURNS). search gives (query_id, doc_id, rank) for (query_id, text) and a number of hits. kb: passages by doc_id with section_id,
    title, domain, subdomain, effective_date, content and _ord, by which the first of an id counts.
    """
    fields = kb.select(F.col("doc_id").alias("_d"), "domain", "subdomain", "effective_date", "content")
    state = questions.select("query_id", "question", "domain", "slots").withColumn("turns", F.array().cast(TURNS))
    got, outputs, log, seen = [], [], [], None
    for k in range(rounds):
        asked = cut(state.withColumn("reply", policy(k)).withColumn("call", parsed_action(F.col("reply"))), "agent-round")
        going = asked.where("call IS NOT NULL").select("query_id", "slots", "turns", "reply", "call.*")
        first = F.lit(k * (hits + 1)).cast("long")
        # Every key that a question has seen is a row; what a search or a lookup brings again is no passage.
        found = search(going.where("tool = 'SearchKB'").select("query_id", F.col("argument").alias("text")), hits).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"))
        found = found.join(fields, F.col("doc_id") == F.col("_d")).select("query_id", (F.col("rank") + first).alias("rank"), F.col("doc_id").alias("key"), "doc_id", "domain", "subdomain", "effective_date", "content")
        lookups = going.where("tool = 'GetPolicy'").select("query_id", F.col("argument").alias("identifier"))
        looked = generation.formatted_policy(lookups, kb, keep=True)
        policies = looked.where("doc IS NOT NULL").select("query_id", first.alias("rank"), F.col("identifier").alias("key"), *[F.col(f"doc.{c}") for c in PASSAGE[2:]])
        new = found.unionByName(policies)
        new = cut(new if seen is None else new.join(seen, ["query_id", "key"], "left_anti"), "agent-passages")
        pay = cut(payslip_texts(going.where("tool = 'ParsePayslip'")), "agent-payslips")
        seen = new.select("query_id", "key") if seen is None else seen.unionByName(new.select("query_id", "key"))
        got.append(new.drop("key"))
        outputs.append(generation.tool_passage(pay, k))
        heard = _said(new.join(going.where("tool = 'SearchKB'").select("query_id"), "query_id", "left_semi")).unionByName(looked.select("query_id", F.col("text").alias("observation"))).unionByName(pay.select("query_id", F.col("text").alias("observation")))
        heard = going.join(heard, "query_id", "left").withColumn("observation", F.coalesce("observation", F.lit(NONE_NEW)))
        heard = cut(heard, "agent-turns")
        log.append(asked.select("query_id", F.lit(k).alias("round"), "reply", "call.tool", "call.argument").join(heard.select("query_id", "observation"), "query_id", "left"))
        turn = F.struct("reply", "observation")
        state = questions.select("query_id", "question", "domain", "slots").join(heard.select("query_id", F.concat("turns", F.array(turn)).alias("turns")), "query_id")
    passages, tools, turns = got[0], outputs[0], log[0]
    for p, t, s in zip(got[1:], outputs[1:], log[1:], strict=True):
        passages, tools, turns = passages.unionByName(p), tools.unionByName(t), turns.unionByName(s)
    without = cut(questions.select("query_id", F.col("question").alias("text")).join(passages.select("query_id").unionByName(tools.select("query_id")).distinct(), "query_id", "left_anti"), "agent-fallback")
    back = search(without, hits).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"))
    back = back.join(fields, F.col("doc_id") == F.col("_d")).select(*PASSAGE)
    every = generation.with_tools(passages.select(*PASSAGE), tools.select(*PASSAGE), back)
    own = every.join(questions.select("query_id", F.col("domain").alias("_asked")), "query_id")
    return retrieve.own_domain_first(own, F.col("_asked")).drop("_asked"), turns
