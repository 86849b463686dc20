"""The whole way from questions to answers, and checks on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import tables as T
from tessella.operators import answering, retrieve
from tessella.plans import corpus
from tessella.plans import sql as Q
from tessella.plans.base import query, question_sql, table

#: Conditions of a document by its length modulo 7, as a knowledge base writes them. Written for these queries.
CONDITIONS = (
    (), ("service_years >= 5",), ("kyc_status == verified", "warning: service_years > 2"), ("employment_status is known",), ("employment_years >= 5", "service_years < 3"), ("basic_salary <= 15000", "no condition at all"),
    ("annual_income > 250000", "service_years >= 5"),
)
#: The same as (length modulo 7, place, field, operator, value, mandatory).
_READ = "(VALUES (1, 0, 'service_years', 'gte', '5', true), (2, 0, 'kyc_status', 'eq', 'verified', true), (2, 1, 'service_years', 'gt', '2', false), (3, 0, 'employment_status', 'not_null', NULL, true), (4, 0, 'employment_years', 'gte', '5', true), (4, 1, 'service_years', 'lt', '3', true), (5, 0, 'basic_salary', 'lte', '15000', true), (6, 0, 'annual_income', 'gt', '250000', true), (6, 1, 'service_years', 'gte', '5', true)) AS k(k, pos, field, operator, value, mandatory)"

#: Questions: the first message of a conversation, with a question put behind it by the message's length.
_QUESTION = f"text || ' ' || {question_sql('length(text)')}"
_ASKED = f"SELECT conv_id AS query_id, {_QUESTION} AS text FROM conversations WHERE turn = 0 AND role = 'user' AND text IS NOT NULL"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("turn = 0 AND role = 'user' AND text IS NOT NULL").select(F.col("conv_id").alias("query_id"), F.expr(_QUESTION).alias("question"))


def answers(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    """questions (query_id, question) answered out of the documents."""
    docs = corpus.documents(spark, sf_dir)
    conditions = F.get(F.array(*[F.array(*[F.lit(c) for c in cs]).cast("array<string>") for cs in CONDITIONS]), F.length("text") % len(CONDITIONS))
    kb = docs.select(F.concat(F.lit("DOC_"), "doc_id").alias("doc_id"), F.lit(None).cast("string").alias("section_id"), F.col("source").alias("title"), "domain", "subdomain", "effective_date", F.col("text").alias("content"), conditions.alias("conditions"), F.col("doc_id").alias("_ord"))
    search = lambda q, k: retrieve.bm25(docs, q, k).withColumn("doc_id", F.concat(F.lit("DOC_"), "doc_id"))
    return answering.answered(questions, kb, search)


_SLOTS = " UNION ALL ".join(f"SELECT query_id, domain, unnest([{', '.join(chr(39) + n + chr(39) for n in T.SLOTS[d])}]) AS slot, unnest([{', '.join(f'CAST({e} AS VARCHAR)' for e in Q.slots(d, 'low').values())}]) AS v FROM x WHERE domain = '{d}'" for d in T.DOMAINS)
_NORMAL = lambda c: f"CASE lower(trim({c})) " + " ".join(f"WHEN {Q.text(k)} THEN {Q.text(v)}" for k, v in T.VALUE_ALIASES.items()) + f" ELSE lower(trim({c})) END"
_SUBS = "(VALUES " + ", ".join(f"('{i}', '{s}')" for i, ss in T.INTENT_SUBDOMAINS.items() for s in ss) + ") AS w(intent, subdomain)"
_KIN = " OR ".join(f"(ask = '{d}' AND domain IN ({', '.join(map(Q.text, ds))}))" for d, ds in T.RELATED_DOMAINS.items())
_LINE = lambda mark, tail="": f"'    {mark} ' || field || ' ' || operator || ' ' || coalesce(value, 'None') || ' [' || doc || ']'{tail}"
_LISTED = lambda line, test: f"string_agg({line}, chr(10) ORDER BY place, pos) FILTER ({test})"
ANSWERS = f"""{corpus._bm25_sql(corpus.SEARCH_SQL, True, 4, asked=_ASKED)}, x AS (SELECT *, {Q.route('low')} AS domain FROM (SELECT query_id, text, lower(text) AS low FROM ({_ASKED}))),
sl AS ({_SLOTS}), i AS (SELECT query_id, domain, v AS intent FROM sl WHERE slot = 'intent'),
mi AS (SELECT i.query_id, list(need.slot ORDER BY need.pos) AS missing FROM i JOIN {Q.required()} ON need.intent = i.intent AND need.domain = i.domain JOIN sl ON sl.query_id = i.query_id AND sl.slot = need.slot WHERE sl.v IS NULL AND i.intent NOT IN ({', '.join(map(Q.text, T.CONTEXT_FREE_INTENTS))}) GROUP BY i.query_id),
g AS (SELECT i.*, mi.missing IS NULL AS sufficient, gq.question, mi.missing FROM i LEFT JOIN mi USING (query_id) LEFT JOIN {Q.pairs(T.GATE_QUESTIONS, 'gq(slot, question)')} ON gq.slot = missing[1]),
p0 AS (SELECT h.query_id, h.doc_id, h.rank, {corpus.DOMAIN.replace('doc_id', 'h.doc_id')} AS domain, {corpus.SUBDOMAIN.replace('doc_id', 'h.doc_id')} AS subdomain, {corpus.DATE.replace('doc_id', 'h.doc_id')} AS effective_date, dd.text, g.domain AS ask, intent FROM hits h JOIN g USING (query_id) JOIN documents dd ON dd.doc_id = h.doc_id WHERE sufficient),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (domain = ask)::INT DESC, rank) AS place FROM p0),
m0 AS (SELECT *, EXISTS (SELECT 1 FROM {_SUBS} WHERE w.intent = pl.intent AND w.subdomain = pl.subdomain) AS hit FROM pl), ml AS (SELECT * FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS met FROM m0) WHERE hit OR NOT met),
c0 AS (SELECT query_id, place, pos, field, operator, value, mandatory, 'DOC_' || doc_id AS doc FROM ml JOIN {_READ} ON k.k = length(text) % 7 WHERE intent IN ({', '.join(map(Q.text, T.REASONING_INTENTS))}) AND ({_KIN})),
c1 AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY query_id, field, operator ORDER BY place, pos) = 1),
c2 AS (SELECT c1.*, sl.v AS sv FROM c1 LEFT JOIN sl ON sl.query_id = c1.query_id AND sl.slot = c1.field),
c AS (SELECT *, CASE WHEN sv IS NULL THEN NULL WHEN operator = 'not_null' THEN true WHEN operator = 'eq' THEN {_NORMAL('sv')} = {_NORMAL('value')} WHEN operator = 'gte' THEN try_cast(sv AS DOUBLE) >= value::DOUBLE WHEN operator = 'lte' THEN try_cast(sv AS DOUBLE) <= value::DOUBLE
 WHEN operator = 'gt' THEN try_cast(sv AS DOUBLE) > value::DOUBLE ELSE try_cast(sv AS DOUBLE) < value::DOUBLE END AS met FROM c2),
rr AS (SELECT query_id, count(*) FILTER (mandatory AND met) AS met, count(*) FILTER (mandatory AND NOT met) AS failed, count(*) FILTER (mandatory AND met IS NULL) AS unresolved, count(*) FILTER (mandatory) AS n, arg_min(field, place * 10 + pos) FILTER (mandatory AND met IS NULL) AS first_open,
 {_LISTED(_LINE('✓'), 'mandatory AND met')} AS l_met, {_LISTED(_LINE('✗', " || ' (user value: ' || sv || ')'"), 'mandatory AND NOT met')} AS l_failed, {_LISTED(_LINE('⚠'), 'NOT mandatory AND met')} AS l_warn, {_LISTED("'    ? ' || field || ' — slot missing'", 'mandatory AND met IS NULL')} AS l_open FROM c GROUP BY query_id),
rz AS (SELECT g.*, coalesce(met, 0) AS met, coalesce(failed, 0) AS failed, coalesce(unresolved, 0) AS unresolved, coalesce(n, 0) AS n, first_open, l_met, l_failed, l_warn, l_open, sufficient AND intent IN ({', '.join(map(Q.text, T.REASONING_INTENTS))}) AS runs FROM g LEFT JOIN rr USING (query_id)),
dz AS (SELECT *, CASE WHEN NOT sufficient THEN 'ASK' WHEN NOT runs OR failed > 0 THEN 'ANSWER' WHEN unresolved > 0 THEN 'ASK' WHEN n = 0 THEN 'ESCALATE' ELSE 'ANSWER' END AS decision, CASE WHEN NOT runs THEN NULL WHEN failed > 0 THEN false WHEN unresolved > 0 OR n = 0 THEN NULL ELSE true END AS eligible,
 CASE WHEN NOT sufficient THEN 0.0::DOUBLE WHEN NOT runs THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0::DOUBLE ELSE round_even((met + failed) / n, 2) END AS coverage FROM rz),
t AS (SELECT *, CASE WHEN NOT sufficient THEN NULL WHEN NOT runs THEN '' ELSE concat_ws(chr(10), 'ELIGIBILITY REASONING TRACE:', '  Decision : ' || decision, CASE WHEN eligible THEN '  Eligible : True' WHEN NOT eligible THEN '  Eligible : False' END, '  Coverage : ' || coverage::VARCHAR,
 '  Met conditions:' || chr(10) || l_met, '  Failed conditions:' || chr(10) || l_failed, '  Warnings (non-blocking):' || chr(10) || l_warn, '  Unresolved:' || chr(10) || l_open) END AS trace FROM dz),
s2 AS (SELECT query_id, string_agg('[DOC_' || doc_id || ']', ' ' ORDER BY place) AS cites FROM pl GROUP BY query_id),
a AS (SELECT t.*, CASE WHEN decision <> 'ASK' THEN CASE WHEN cites IS NULL THEN '**Result:** no source covers this; please escalate.' ELSE '**Result:** according to the sources ' || cites || '.' END WHEN NOT sufficient THEN coalesce(question, 'Could you provide your ' || replace(missing[1], '_', ' ') || '?')
 ELSE coalesce(rq.ask, 'Could you provide your ' || replace(first_open, '_', ' ') || '?') END AS response FROM t LEFT JOIN s2 USING (query_id) LEFT JOIN {Q.pairs(T.REASONER_QUESTIONS, 'rq(field, ask)')} ON rq.field = first_open)"""


@query(f"{ANSWERS} SELECT query_id, domain, intent, decision, coverage, response, trace FROM a")
def question_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's first message through the whole plan: decision, coverage, response and trace."""
    return answers(spark, sf_dir, asked(spark, sf_dir)).select("query_id", "domain", "intent", "decision", "coverage", "response", "trace")


#: What must hold of every answer, by name; the same conditions as SQL for either engine.
CHECKS = {
    "decision_known": "decision IN ('ANSWER', 'ASK', 'ESCALATE')", "response_given": "length(response) > 0", "coverage_in_range": "coverage BETWEEN 0 AND 1", "domain_known": f"domain IN ({', '.join(map(Q.text, T.DOMAINS))})",
    "asks_end_in_question_mark": "decision <> 'ASK' OR response LIKE '%?'", "escalates_without_coverage": "decision <> 'ESCALATE' OR coverage = 0", "answers_cite": "decision = 'ASK' OR response LIKE '%[DOC_%' OR response LIKE '%no source%'", "trace_where_reasoned": "decision <> 'ESCALATE' OR trace LIKE '%Decision : ESCALATE%'",
}


@query(f"{ANSWERS} " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, coalesce(sum((NOT ({c}))::INT), 0)::BIGINT AS failed FROM a" for n, c in CHECKS.items()))
def pipeline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on the whole plan's answers: how many answers each looked at, and how many failed it."""
    a = answers(spark, sf_dir, asked(spark, sf_dir))
    counted = a.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.expr(c)).alias(k) for k, c in CHECKS.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), "n", F.col(k).cast("long").alias("failed")) for k in CHECKS]))
    return counted.select(rows.alias("x")).select("x.*")
