"""Questions to answers as one plan: route, slots, gate, retrieval, passage filter, conditions, resolution, trace, prompt, answer.

Every step is a join or an expression over all questions. Questions that the gate or the reasoner asks back leave the plan with their question; only the others are sent
to a generator. What a question gathers (passages, conditions) is a few rows, bounded by the number of hits and of tool calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions import slots as S
from tessella.functions import tables as T
from tessella.functions import text as X
from tessella.operators import agent, endpoints, generation, retrieve
from tessella.operators.storage import cut

#: What a condition in the knowledge base begins with if it only warns.
OPTIONAL = "warning:"


def prepared(questions: DataFrame) -> DataFrame:
    """questions (query_id, question) with domain, slots (a string map), intent, gate, and `lines`: the slots that have a value, as members of a JSON object of their own types."""
    q = questions.withColumn("domain", S.route(F.col("question")))
    slots, lines = F, F
    for d in T.DOMAINS:
        made = list(zip(S.extract(F.col("question"), d), T.SLOTS[d], strict=True))
        slots = slots.when(F.col("domain") == d, F.create_map(*[x for c, n in made for x in (F.lit(n), c.cast("string"))]))
        member = lambda c, n: F.when(c.isNotNull(), F.concat(F.lit(f'  "{n}": '), F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")))
        lines = lines.when(F.col("domain") == d, F.array_compact(F.array(*[member(c, n) for c, n in made])))
    q = q.withColumn("slots", slots.otherwise(None)).withColumn("lines", lines.otherwise(None))
    return q.withColumn("intent", F.coalesce(F.try_element_at("slots", F.lit("intent")), F.lit("general"))).withColumn("gate", R.gate(F.col("slots"), F.col("domain")))


def parsed(conditions: Column) -> Column:
    """Conditions as text, in the knowledge base's grammar, as structs; those that can't be read are left out, and those marked OPTIONAL aren't mandatory."""
    one = lambda c: R.parsed_condition(F.regexp_replace(c, rf"^\s*{OPTIONAL}", ""))
    made = F.transform(conditions, lambda c: F.when(one(c).isNotNull(), F.struct(one(c)["field"].alias("field"), one(c)["operator"].alias("operator"), one(c)["value"].alias("value"), (~F.ltrim(c).startswith(OPTIONAL)).alias("mandatory"), F.lit(None).cast("string").alias("doc_id"))))
    return F.array_compact(made)


def for_reasoner(passages: DataFrame) -> DataFrame:
    """passages (query_id, intent, subdomain, ...) of the subdomains of their question's intent, or all of a question where there are none or the intent has no subdomains."""
    match = F.lit(False)
    for intent, subs in T.INTENT_SUBDOMAINS.items():
        match = match | ((F.col("intent") == intent) & F.col("subdomain").isin(*subs))
    return retrieve.matching_or_all(passages, match)


def traced(reasoned: Column) -> Column:
    """The reasoner's trace, also where it escalates; empty where it didn't run."""
    return F.when(reasoned.isNotNull(), generation.trace_text(reasoned)).otherwise("")


ANSWERED = ("query_id", "domain", "intent", "decision", "coverage", "response", "trace", "prompt", "doc_ids")


def answered(questions: DataFrame, kb: DataFrame, search: agent.Search, endpoint: endpoints.Endpoint = endpoints.echo_generator, policy=None, hits: int = agent.HITS) -> DataFrame:
    """ANSWERED of questions (query_id, question).

    kb: as for agent.gather, with `conditions`, an array of texts. With a policy (see agent) passages are gathered in rounds with tools, without one by a search of the question. Decisions: ASK by
    the gate (coverage 0) or the reasoner, with the question as response; ANSWER or ESCALATE as the reasoner decides; ANSWER with coverage 1 where the intent isn't reasoned about.
    """
    q = cut(prepared(questions), "answer-questions")
    going = q.where("gate.sufficient")
    if policy is None:
        found = search(going.select("query_id", F.col("question").alias("text")), hits).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("doc_id").cast("string").alias("doc_id"))
        fields = kb.select(F.col("doc_id").alias("_d"), "domain", "subdomain", "effective_date", "content")
        found = found.join(fields, F.col("doc_id") == F.col("_d")).drop("_d").join(going.select("query_id", F.col("domain").alias("_asked")), "query_id")
        found = retrieve.own_domain_first(found, F.col("_asked")).drop("_asked")
    else:
        found, _ = agent.gather(going.select("query_id", "question", "domain", "slots"), policy, search, kb, hits=hits)
    found = cut(found, "answer-passages")
    rules = kb.where(F.size("conditions") > 0).select(F.col("doc_id").alias("_d"), parsed(F.col("conditions")).alias("conditions"))
    judged = for_reasoner(found.join(going.select("query_id", "intent", F.col("domain").alias("asked")), "query_id"))
    judged = judged.join(rules, F.col("doc_id") == F.col("_d")).select("query_id", F.col("place").alias("rank"), "doc_id", "domain", "asked", "intent", "conditions")
    resolved = generation.reasoned(going.where(F.col("intent").isin(*T.REASONING_INTENTS)).select("query_id", "slots"), generation.conditions(judged)).select("query_id", "r")
    hit = F.struct("place", "doc_id", "effective_date", "domain", F.coalesce("content", F.lit("")).alias("content"))
    shown = found.groupBy(F.col("query_id").alias("_q")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    every = q.join(resolved, "query_id", "left").join(shown, F.col("query_id") == F.col("_q"), "left").drop("_q")
    every = every.withColumn("hits", F.coalesce("hits", F.array().cast(shown.schema["hits"].dataType)))
    asks = ~F.col("gate.sufficient") | F.coalesce(F.col("r.decision") == "ASK", F.lit(False))
    members = F.when(F.size("lines") == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join("lines", ",\n"), F.lit("\n}")))
    text = F.concat_ws("\n\n", F.concat(F.lit("USER QUERY:\n"), "question"), F.concat(F.lit("DOMAIN: "), "domain"), F.concat(F.lit("RETRIEVED PASSAGES:\n"), X.prompt_block(F.col("hits"))), traced(F.col("r")),
                       F.concat(F.lit("SLOTS FILLED:\n"), members), F.lit("Produce the final answer now."))
    made = cut(every.withColumn("prompt", F.when(~asks, text)).withColumn("asks", asks), "answer-prompts")
    said = made.withColumn("response", F.when(F.col("asks"), F.coalesce("gate.question", "r.question")).otherwise(endpoints.column(endpoint, F.col("prompt"))))
    decision = F.when(~F.col("gate.sufficient"), "ASK").otherwise(F.coalesce("r.decision", F.lit("ANSWER")))
    coverage = F.when(~F.col("gate.sufficient"), 0.0).otherwise(F.coalesce("r.coverage", F.lit(1.0)))
    return said.select("query_id", "domain", "intent", decision.alias("decision"), coverage.alias("coverage"), "response", F.when(F.col("gate.sufficient"), traced(F.col("r"))).alias("trace"), "prompt", F.col("hits.doc_id").alias("doc_ids"))
