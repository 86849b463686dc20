"""Queries on the reasoner, tools, passages and answers that generation chooses, and its budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import tables as T
from tessella.functions import text as X
from tessella.operators import agent, answering, closed_loop, generation, retrieve, synthesis
from tessella.plans import corpus
from tessella.plans import slots as S
from tessella.plans import sql as Q
from tessella.plans.base import cut, query, shared_dir, table
from tessella.sources import files

#: Conditions of made-up passages: (field, operator, value, mandatory). Written for these queries.
CONDITIONS = (("service_years", "gte", "5", True), ("age", "lt", "58", True), ("kyc_status", "eq", "verified", True), ("employment_status", "not_null", None, True), ("balance", "gt", "1000", False), ("balance", "lte", "9000", True))
_ASK = "CASE query_id % 5 WHEN 0 THEN 'pf' WHEN 1 THEN 'payslip' WHEN 2 THEN 'labour' WHEN 3 THEN 'tax' ELSE 'general' END"
_INTENT = "CASE query_id % 4 WHEN 3 THEN 'pension' WHEN 2 THEN 'gratuity' ELSE 'full_withdrawal' END"


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of documents as questions, through parse, filter, first of each condition, check and resolve."""
    hits = corpus.topics(spark, sf_dir).withColumns({"asked": F.expr(_ASK), "intent": F.expr(_INTENT)})
    made = [F.struct(F.lit(f).alias("field"), F.lit(o).alias("operator"), F.lit(v).cast("string").alias("value"), F.lit(m).alias("mandatory"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("OWN_"), F.col("doc_id"))).alias("doc_id")) for f, o, v, m in CONDITIONS]
    both = F.array(*[F.get(F.array(*made), F.expr(e).cast("int")) for e in ("doc_id % 6", "(doc_id div 6) % 6")])
    hits = hits.withColumn("conditions", F.when(F.col("doc_id") % 4 != 0, both)).withColumn("doc_id", F.concat(F.lit("DOC_"), F.col("doc_id")))
    q = F.col("query_id")
    slots = F.create_map(
        F.lit("service_years"), F.when(q % 7 != 0, (q % 12).cast("string")), F.lit("age"), (q % 80).cast("string"), F.lit("kyc_status"), F.when(q % 3 == 0, "complete").when(q % 3 == 1, " Done "),
        F.lit("balance"), F.when(q % 6 != 0, ((q * 977) % 12000).cast("string")), F.lit("employment_status"), F.when(q % 2 == 0, "retired"))
    questions = hits.select("query_id", "intent").distinct().withColumn("slots", slots)
    return generation.reasoned(questions, generation.conditions(hits))


_CONDS = "(VALUES " + ", ".join(f"({k}, '{f}', '{o}', {'NULL' if v is None else Q.text(v)}, {str(m).lower()})" for k, (f, o, v, m) in enumerate(CONDITIONS)) + ") AS k(k, field, operator, value, mandatory)"
REASONED = f"""WITH h AS (SELECT *, {_ASK} AS asked, {_INTENT} AS intent FROM ({corpus._TOPIC})),
p AS (SELECT *, asked AS ask FROM h WHERE intent IN ({', '.join(map(Q.text, T.REASONING_INTENTS))}) AND (asked = 'general' OR {corpus._RELATED.replace('ask =', 'asked =')}) AND doc_id % 4 <> 0),
c AS (SELECT query_id, rank, pos, k.field, k.operator, k.value, k.mandatory, CASE WHEN doc_id % 2 = 0 THEN 'OWN_' ELSE 'DOC_' END || doc_id AS doc FROM p, (VALUES (0), (1)) AS v(pos), {_CONDS} WHERE k.k = CASE pos WHEN 0 THEN doc_id % 6 ELSE (doc_id // 6) % 6 END),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, field, operator ORDER BY rank, pos) AS n FROM c) WHERE n = 1),
s AS (SELECT *, CASE field WHEN 'service_years' THEN CASE WHEN query_id % 7 <> 0 THEN (query_id % 12)::VARCHAR END WHEN 'age' THEN (query_id % 80)::VARCHAR WHEN 'kyc_status' THEN CASE query_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN ' Done ' END
 WHEN 'balance' THEN CASE WHEN query_id % 6 <> 0 THEN ((query_id * 977) % 12000)::VARCHAR END ELSE CASE WHEN query_id % 2 = 0 THEN 'retired' END END AS sv FROM f),
m AS (SELECT *, CASE WHEN sv IS NULL THEN NULL WHEN field = 'kyc_status' THEN true WHEN operator = 'not_null' THEN true WHEN operator = 'gte' THEN sv::INT >= value::INT WHEN operator = 'lt' THEN sv::INT < value::INT WHEN operator = 'gt' THEN sv::INT > value::INT ELSE sv::INT <= value::INT END AS met FROM s),
g AS (SELECT query_id, count(*) FILTER (mandatory AND met) AS met, count(*) FILTER (mandatory AND NOT met) AS failed, count(*) FILTER (mandatory AND met IS NULL) AS unresolved, count(*) FILTER (NOT mandatory AND met) AS warnings, count(*) FILTER (mandatory) AS n,
 arg_min(field, rank * 10 + pos) FILTER (mandatory AND met IS NULL) AS first_open,
 string_agg('    ✓ ' || field || ' ' || operator || ' ' || coalesce(value, 'None') || ' [' || doc || ']', chr(10) ORDER BY rank, pos) FILTER (mandatory AND met) AS l_met,
 string_agg('    ✗ ' || field || ' ' || operator || ' ' || coalesce(value, 'None') || ' [' || doc || '] (user value: ' || sv || ')', chr(10) ORDER BY rank, pos) FILTER (mandatory AND NOT met) AS l_failed,
 string_agg('    ⚠ ' || field || ' ' || operator || ' ' || coalesce(value, 'None') || ' [' || doc || ']', chr(10) ORDER BY rank, pos) FILTER (NOT mandatory AND met) AS l_warn,
 string_agg('    ? ' || field || ' — slot missing', chr(10) ORDER BY rank, pos) FILTER (mandatory AND met IS NULL) AS l_open FROM m GROUP BY query_id),
o AS (SELECT a.query_id, coalesce(met, 0) AS met, coalesce(failed, 0) AS failed, coalesce(unresolved, 0) AS unresolved, coalesce(warnings, 0) AS warnings, coalesce(n, 0) AS n, first_open, l_met, l_failed, l_warn, l_open FROM (SELECT DISTINCT query_id FROM h) a LEFT JOIN g USING (query_id)),
e AS (SELECT *, {_INTENT} IN ({', '.join(map(Q.text, T.REASONING_INTENTS))}) AS runs FROM o),
d AS (SELECT *, CASE WHEN NOT runs OR failed > 0 THEN 'ANSWER' WHEN unresolved > 0 THEN 'ASK' WHEN n = 0 THEN 'ESCALATE' ELSE 'ANSWER' END AS decision, CASE WHEN NOT runs THEN NULL WHEN failed > 0 THEN false WHEN unresolved > 0 OR n = 0 THEN NULL ELSE true END AS eligible,
 CASE WHEN NOT runs THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0::DOUBLE ELSE round_even((met + failed) / n, 2) END AS coverage FROM e)"""
_TRACE = """CASE WHEN NOT runs THEN '' ELSE concat_ws(chr(10), 'ELIGIBILITY REASONING TRACE:', '  Decision : ' || decision, CASE WHEN eligible THEN '  Eligible : True' WHEN NOT eligible THEN '  Eligible : False' END, '  Coverage : ' || coverage::VARCHAR,
 '  Met conditions:' || chr(10) || l_met, '  Failed conditions:' || chr(10) || l_failed, '  Warnings (non-blocking):' || chr(10) || l_warn, '  Unresolved:' || chr(10) || l_open) END"""


@query(f"""{REASONED} SELECT query_id, decision, eligible, coverage, met, failed, unresolved, warnings, CASE WHEN failed = 0 THEN coalesce(q.question, CASE WHEN first_open IS NOT NULL THEN 'Could you provide your ' || replace(first_open, '_', ' ') || '?' END) END AS question,
 {_TRACE} AS trace FROM d LEFT JOIN {Q.pairs(T.REASONER_QUESTIONS, 'q(field, question)')} ON q.field = first_open""")
def reasoner_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision, question and trace of every topic; a topic without conditions escalates, one that isn't reasoned about is answered with full coverage and no trace."""
    r = reasoned(spark, sf_dir)
    sizes = [F.coalesce(F.size(f"r.{n}"), F.lit(0)).cast("long").alias(n) for n in ("met", "failed", "unresolved", "warnings")]
    return r.select("query_id", F.coalesce("r.decision", F.lit("ANSWER")).alias("decision"), "r.eligible", F.coalesce("r.coverage", F.lit(1.0)).alias("coverage"), *sizes, "r.question", answering.traced(F.col("r")).alias("trace"))


_SLOT_LINES = """array_to_string(list_filter(['  "service_years": "' || CASE WHEN query_id % 7 <> 0 THEN (query_id % 12) END || '"', '  "age": "' || (query_id % 80) || '"', CASE query_id % 3 WHEN 0 THEN '  "kyc_status": "complete"' WHEN 1 THEN '  "kyc_status": " Done "' END,
 '  "balance": "' || CASE WHEN query_id % 6 <> 0 THEN (query_id * 977) % 12000 END || '"', CASE WHEN query_id % 2 = 0 THEN '  "employment_status": "retired"' END], lambda x: x IS NOT NULL), ',' || chr(10))"""


@query(f"""{REASONED} SELECT query_id, 'USER QUERY:' || chr(10) || 'topic ' || query_id || chr(10) || chr(10) || 'DOMAIN: pf' || chr(10) || chr(10) || 'RETRIEVED PASSAGES:' || chr(10) || '-' || chr(10) || chr(10) || {_TRACE} || chr(10) || chr(10) ||
 'SLOTS FILLED:' || chr(10) || '{{' || chr(10) || {_SLOT_LINES} || chr(10) || '}}' || chr(10) || chr(10) || 'Produce the final answer now.' AS text FROM d""")
def generator_input_with_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a generator reads, with the reasoner's trace (an empty one where it didn't run) and slots as indented JSON."""
    r = reasoned(spark, sf_dir)
    trace = answering.traced(F.col("r"))
    return r.select("query_id", corpus.generator_text(F.concat(F.lit("topic "), F.col("query_id")), F.lit("pf"), F.lit("-"), trace, generation.json_indented(F.col("slots"))).alias("text"))


_DOMAINS = "CASE query_id % 4 WHEN 0 THEN 'pf' WHEN 1 THEN 'payslip' WHEN 2 THEN 'labour' ELSE 'tax' END"


@query(f"""WITH h AS ({corpus._TOPIC}), found AS (SELECT query_id, rank, doc_id::VARCHAR AS doc_id, domain FROM h WHERE query_id % 3 <> 0 AND rank % 2 = 0 AND rank <= 8),
tools AS (SELECT DISTINCT query_id, 1 << 30 AS rank, '{T.TOOL_DOC}' AS doc_id, 'payslip' AS domain FROM h WHERE query_id % 4 = 1), b AS (SELECT * FROM found UNION ALL SELECT * FROM tools),
a AS (SELECT * FROM b UNION ALL SELECT query_id, rank, doc_id::VARCHAR, domain FROM h WHERE rank <= 4 AND query_id NOT IN (SELECT query_id FROM b))
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (domain = {_DOMAINS})::INT DESC, rank) AS place FROM a""")
def react_with_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rounds found (nothing for some topics), the tool's output behind it for some, and the fallback where there is neither; own domain first."""
    h = corpus.topics(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")).select("query_id", "rank", "doc_id", "domain", "subdomain", "effective_date")
    found = h.where("query_id % 3 <> 0 AND rank % 2 = 0 AND rank <= 8")
    tools = generation.tool_passage(h.where("query_id % 4 = 1").select("query_id", F.lit("").alias("text")).distinct()).drop("content")
    every = generation.with_tools(found, tools, h.where("rank <= 4"))
    return retrieve.own_domain_first(every, F.expr(_DOMAINS)).select("query_id", "doc_id", "place")


#: The agent's script: what a round does follows from the length n of the question, its words t, and the last observation.
_TOPIC_OF = "CASE n % 3 WHEN 0 THEN 'pf' WHEN 1 THEN 'payslip' ELSE 'tax' END"
_SEARCHES = f"""SELECT item_id * 4 + r AS query_id, CASE r WHEN 3 THEN text ELSE array_to_string(CASE r WHEN 0 THEN t[1:6] WHEN 1 THEN t[greatest(1, len(t) - 5):] ELSE t[4:9] END, ' ') END AS text
 FROM (SELECT item_id, text, {corpus.SEARCH_SQL} AS t FROM benchmark), (VALUES (0), (1), (2), (3)) AS v(r)"""
_AGENT = f"""{corpus._bm25_sql(corpus.SEARCH_SQL, True, 4, asked=_SEARCHES)}, h AS (SELECT query_id // 4 AS query_id, query_id % 4 AS r, rank, doc_id FROM hits),
b AS (SELECT item_id AS query_id, length(text) AS n, {corpus.SEARCH_SQL} AS t, (SELECT arg_min(doc_id, rank) FROM h WHERE h.query_id = item_id AND r = 0) AS best FROM benchmark),
t0 AS (SELECT *, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 4 = 0 THEN 'ParsePayslip' ELSE 'SearchKB' END AS tool0 FROM b),
t1 AS (SELECT *, CASE WHEN tool0 IS NULL THEN NULL WHEN tool0 = 'SearchKB' AND best IS NOT NULL AND n % 3 = 0 THEN 'GetPolicy' ELSE 'SearchKB' END AS tool1 FROM t0),
t2 AS (SELECT *, CASE WHEN tool1 IS NOT NULL AND n % 5 > 1 THEN 'SearchKB' END AS tool2 FROM t1),
e AS (SELECT h.query_id, r AS round, rank, doc_id FROM h JOIN t2 USING (query_id) WHERE (r = 0 AND tool0 = 'SearchKB') OR (r = 1 AND tool1 = 'SearchKB') OR (r = 2 AND tool2 = 'SearchKB')
 UNION ALL SELECT query_id, 1, 0, doc_id FROM t2 JOIN documents ON doc_id = best + 1 WHERE tool1 = 'GetPolicy'),
f AS (SELECT query_id, round * 10 + rank AS o, doc_id::VARCHAR AS doc_id, {corpus.DOMAIN} AS domain FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round, rank) AS k FROM e) WHERE k = 1 UNION ALL SELECT query_id, 1000, '{T.TOOL_DOC}', 'payslip' FROM t2 WHERE tool0 = 'ParsePayslip'),
w AS (SELECT * FROM f UNION ALL SELECT query_id, rank, doc_id::VARCHAR, {corpus.DOMAIN} FROM h WHERE r = 3 AND query_id NOT IN (SELECT query_id FROM f))"""


def scripted(round_: int):
    n, t = F.length("question"), X.search_tokens(F.col("question"))
    search = lambda words: F.concat(F.lit('Thought: look.\nAction: SearchKB("'), F.array_join(words, " "), F.lit('")'))
    if round_ == 0:
        return F.when(n % 7 == 0, "Done: nothing to look up.").when(n % 4 == 0, "Action: ParsePayslip()").otherwise(search(F.slice(t, 1, 6)))
    if round_ == 1:
        seen = F.regexp_extract(F.element_at("turns", -1)["observation"], r"^doc_id=(\d+)", 1)
        lookup = F.concat(F.lit("Action: GetPolicy('"), (seen.try_cast("long") + 1).cast("string"), F.lit("')"))
        return F.when((seen != "") & (n % 3 == 0), lookup).otherwise(search(F.slice(t, F.greatest(F.lit(1), F.size(t) - 5), F.lit(6))))
    return F.when(n % 5 == 0, "Thought: nothing more.").when(n % 5 == 1, "Done: I have enough information.").otherwise(search(F.slice(t, 4, 6)))


def agent_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus.documents(spark, sf_dir)
    slots = F.create_map(F.lit("basic_salary"), (F.col("n") * 100).cast("string"), F.lit("state"), F.lit("Karnataka"))
    asked = corpus.asked(spark, sf_dir).withColumn("n", F.length("text")).select("query_id", F.col("text").alias("question"), F.expr(_TOPIC_OF).alias("domain"), slots.alias("slots"))
    kb = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("section_id"), F.col("source").alias("title"), "domain", "subdomain", "effective_date", F.col("text").alias("content"), F.col("doc_id").alias("_ord"))
    index = retrieve.indexed(docs)
    return agent.gather(asked, scripted, lambda q, k: retrieve.bm25(index, q, k), kb)


@query(f"""{_AGENT} SELECT w.query_id, doc_id, row_number() OVER (PARTITION BY w.query_id ORDER BY (domain = {_TOPIC_OF})::INT DESC, o) AS place FROM w JOIN t2 USING (query_id)""")
def agent_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions to an agent of three rounds with all three tools, over the documents."""
    return agent_run(spark, sf_dir)[0].select("query_id", "doc_id", "place")


@query(f"""{_AGENT}, c AS (SELECT query_id, 0 AS round, tool0 AS tool, CASE tool0 WHEN 'SearchKB' THEN array_to_string(t[1:6], ' ') END AS argument FROM t2
 UNION ALL SELECT query_id, 1, tool1, CASE tool1 WHEN 'SearchKB' THEN array_to_string(t[greatest(1, len(t) - 5):], ' ') ELSE (best + 1)::VARCHAR END FROM t2 WHERE tool0 IS NOT NULL
 UNION ALL SELECT query_id, 2, tool2, CASE WHEN tool2 IS NOT NULL THEN array_to_string(t[4:9], ' ') END FROM t2 WHERE tool1 IS NOT NULL) SELECT * FROM c""")
def agent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of these agents: the tool and its argument, null where the question stopped."""
    return agent_run(spark, sf_dir)[1].select("query_id", F.col("round").cast("int").alias("round"), "tool", "argument")


@query(f"""WITH p AS (SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN concat('D', doc_id // 4) END AS id, concat('S', doc_id // 3) AS sec, source AS title, {corpus.DOMAIN} AS domain, {corpus.DATE} AS effective_date, coalesce(md5(text), '') AS content FROM documents),
a AS (SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN concat('D', event_id // 7) WHEN 1 THEN concat('S', event_id // 5) ELSE concat('X', event_id) END AS identifier FROM events),
t AS (SELECT *, 'doc_id: ' || coalesce(id, 'None') || chr(10) || 'title: ' || coalesce(title, 'None') || chr(10) || 'domain: ' || domain || chr(10) || 'effective_date: ' || coalesce(effective_date, 'None') || chr(10) || 'content:' || chr(10) || content AS text FROM p),
d AS (SELECT id AS k, arg_min(text, ord) AS text FROM t WHERE id IS NOT NULL GROUP BY id), s AS (SELECT sec AS k, arg_min(text, ord) AS text FROM t GROUP BY sec)
SELECT n, coalesce(d.text, s.text, '[GetPolicy] No document found for ''' || identifier || '''') AS text FROM a LEFT JOIN d ON d.k = identifier LEFT JOIN s ON s.k = identifier""")
def policy_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.documents(spark, sf_dir).select(
        F.col("doc_id").alias("_ord"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("D"), F.floor(F.col("doc_id") / 4))).alias("doc_id"), F.concat(F.lit("S"), F.floor(F.col("doc_id") / 3)).alias("section_id"), F.col("source").alias("title"), "domain", "effective_date", F.md5("text").alias("content"))
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.expr("CASE event_id % 3 WHEN 0 THEN concat('D', event_id div 7) WHEN 1 THEN concat('S', event_id div 5) ELSE concat('X', event_id) END").alias("identifier"))
    return generation.formatted_policy(a, p).select("n", "text")


def _draw(name: str, n: str) -> str:
    return f"(('0x' || substr(md5(id::VARCHAR || '|{name}'), 1, 7))::BIGINT % ({n}))"


_AREA = "CASE id % 4 WHEN 0 THEN 'pf' WHEN 1 THEN 'payslip' WHEN 2 THEN 'labour' ELSE 'tax' END AS domain, CASE id % 3 WHEN 0 THEN 'withdrawal' WHEN 1 THEN 'transfer' ELSE 'gratuity' END AS subdomain"


@query(f"""WITH d AS (SELECT doc_id, {corpus.DOMAIN} AS domain, {corpus.SUBDOMAIN} AS subdomain FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY domain, subdomain ORDER BY substr(md5(doc_id::VARCHAR), 1, 2), doc_id) - 1 AS number, count(*) OVER (PARTITION BY domain, subdomain) AS size FROM d),
a AS (SELECT id, {_AREA} FROM (SELECT c_custkey AS id FROM customer)), z AS (SELECT DISTINCT domain, subdomain, size FROM n),
w AS (SELECT a.*, size, least({_draw('n', '2')} + 2, 3, size) AS n, {_draw('first', 'size')} AS f, 1 + {_draw('step', 'greatest(1, (size - 1) // 2)')} AS s FROM a JOIN z USING (domain, subdomain)),
k AS (SELECT *, unnest(range(0, n)) AS k FROM w), p AS (SELECT k.id, list(n.doc_id ORDER BY k.k) AS picked FROM k JOIN n ON n.domain = k.domain AND n.subdomain = k.subdomain AND n.number = (k.f + k.k * k.s) % k.size GROUP BY k.id),
x AS (SELECT id, 0 AS pos, 3 AS doc_id FROM a UNION ALL SELECT id, 1, id % 7 FROM a WHERE id % 7 <> 3), c AS (SELECT p.id, list(x.doc_id ORDER BY pos) AS more FROM x JOIN p USING (id) JOIN documents USING (doc_id) WHERE NOT list_contains(picked, x.doc_id) GROUP BY p.id)
SELECT p.id, array_to_string(list_concat(picked, coalesce(more, [])), ',') AS picked FROM p LEFT JOIN c USING (id)""")
def passage_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three documents of a subdomain for every customer, and cross documents, one of which isn't there."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).selectExpr("id", *_AREA.replace(" AS domain, ", " AS domain\n").split("\n"), "array(3L, cast(id % 7 AS bigint), 999999999L) AS cross")
    return generation.chosen_passages(a, corpus.documents(spark, sf_dir)).select("id", F.array_join("picked", ",").alias("picked"))


@query("""WITH a AS (SELECT 't' || event_id % 4 AS intent, 'a=' || user_id % 50 AS slot_key, arg_max('R' || event_id, event_id) AS response FROM events WHERE event_id % 13 <> 0 GROUP BY ALL), q AS (SELECT c_custkey AS id, 't' || c_custkey % 5 AS intent, 'a=' || c_custkey % 60 AS slot_key FROM customer)
SELECT id, coalesce(response, 'T' || id) AS answer, CASE WHEN response IS NULL THEN 'template' ELSE 'reuse' END AS source FROM q LEFT JOIN a USING (intent, slot_key)""")
def answer_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as accepted answers, the last of an intent and slots; some have no response."""
    a = table(spark, sf_dir, "events").selectExpr("concat('t', event_id % 4) AS intent", "concat('a=', user_id % 50) AS slot_key", "CASE WHEN event_id % 13 <> 0 THEN concat('R', event_id) END AS response", "event_id AS _ord")
    q = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat('t', c_custkey % 5) AS intent", "concat('a=', c_custkey % 60) AS slot_key", "concat('T', c_custkey) AS template")
    return generation.reused(q, a).select("id", "answer", "source")


TARGET, CAP = 120, 30
_KEPT = "SELECT event_type AS domain, user_id % 5 AS subdomain, (user_id % 5) * 2 AS n FROM events GROUP BY ALL"


@query(f"""WITH e AS (SELECT event_type AS domain, user_id % 5 AS subdomain, event_id AS attempt, value >= 30 AS accepted FROM events), done AS ({_KEPT}), l AS (SELECT domain, greatest(0, {TARGET} - sum(n)) AS left_ FROM done GROUP BY domain),
t AS (SELECT e.*, left_, row_number() OVER (PARTITION BY domain ORDER BY attempt) AS try FROM e JOIN l USING (domain)), g AS (SELECT * FROM t WHERE try <= 3 * left_ AND accepted),
s AS (SELECT g.*, done.n, row_number() OVER (PARTITION BY g.domain, g.subdomain ORDER BY attempt) AS k FROM g LEFT JOIN done ON done.domain = g.domain AND done.subdomain = g.subdomain),
f AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY attempt) AS d FROM s WHERE k + coalesce(n, 0) <= {CAP}) SELECT domain, subdomain, attempt FROM f WHERE d <= left_""")
def generation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts of a generator that was stopped and goes on: caps on attempts, subdomains and the whole."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("domain"), (F.col("user_id") % 5).alias("subdomain"), F.col("event_id").alias("attempt"), (F.col("value") >= 30).alias("accepted"))
    done = e.select("domain", "subdomain").distinct().withColumn("n", F.col("subdomain") * 2)
    return generation.budgeted(e, TARGET, CAP, done=done).select("domain", "subdomain", "attempt")


LOOP_BATCH = 16
#: Intents by domain, with the subdomains that they fill first and those that give them room.
LOOP_INTENTS = tuple((d, i, s) for d in ("pf", "payslip", "labour", "tax") for i, s in (("withdraw", ("withdrawal",)), ("move", ("transfer", "withdrawal")), ("leave", ("gratuity", "transfer"))))


def loop_inputs(spark: SparkSession, sf_dir: str):
    """(targets, intents, caps, make) of the generation loop over documents: a tenth of a domain's documents are wanted, and a candidate's passages are chosen by hashes.

    Documents are numbered once. A wave's choices, three at most for each of LOOP_BATCH candidates of a domain, are sent to the documents, whose texts aren't exchanged."""
    docs = corpus.documents(spark, sf_dir)
    targets = docs.groupBy("domain").agg(F.greatest(F.lit(5), F.floor(F.count(F.lit(1)) / 10)).cast("long").alias("target"))
    limits = docs.select("domain").distinct().select("domain", F.when(F.col("domain") == "payslip", 12).otherwise(60).alias("abs_cap"), F.lit(10).alias("per_doc"))
    intents = spark.createDataFrame([(d, i, list(s), k) for k, (d, i, s) in enumerate(LOOP_INTENTS)], "domain string, intent string, subdomains array<string>, place int")

    placed = cut(generation.places(docs), "loop-places")

    def make(picks: DataFrame) -> DataFrame:
        asked = picks.select(F.concat_ws("|", "domain", "pick", "intent").alias("id"), "domain", "subdomain").distinct()
        chosen = generation.chosen_passages(asked, docs, placed=placed).select("id", F.posexplode("picked").alias("rank", "doc_id"))
        found = F.broadcast(chosen).join(docs.select("doc_id", "text", "effective_date", F.col("domain").alias("of")), "doc_id")
        hit = F.struct("rank", F.concat(F.lit("DOC_"), F.col("doc_id")).alias("doc_id"), "effective_date", F.col("of").alias("domain"), F.coalesce("text", F.lit("")).alias("content"))
        got = found.groupBy("id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # three at most
        made = picks.withColumn("id", F.concat_ws("|", "domain", "pick", "intent")).join(got, "id", "left")
        short = F.length(F.coalesce(F.get("hits", 0)["content"], F.lit(""))) < 40
        return made.withColumn("prompt", F.when(~short, X.prompt_block(F.col("hits")))).withColumn("allowed", F.col("hits.doc_id")).drop("id", "hits")

    return targets, intents, closed_loop.subdomain_caps(docs, limits), make


def loop_answer(prompt):
    """A stand-in for a generator: it cites the first source and quotes what it was given."""
    cite = F.regexp_extract(prompt, r"(DOC_\d+)", 1)
    return F.concat(F.lit("**Result:** you are eligible ["), cite, F.lit("]. "), F.regexp_replace(F.substring(prompt, 1, 400), r"[\[\]]", " "))


@query()
def generation_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected candidates of a generation loop over documents, and each domain's end (a row without a pick)."""
    g = closed_loop.run(*loop_inputs(spark, sf_dir), loop_answer, synthesis.sft_reason, batch=LOOP_BATCH)
    none = lambda t: F.lit(None).cast(t)
    both = g.accepted.withColumn("reason", F.lit("ok")).unionByName(g.rejected)
    rows = both.select("domain", "pick", "intent", "reason", none("long").alias("n"), none("long").alias("attempts"), none("long").alias("rejects"), none("string").alias("why"))
    return rows.unionByName(g.domains.select("domain", none("long").alias("pick"), none("string").alias("intent"), none("string").alias("reason"), "n", "attempts", "rejects", "why"))


_FILLS = "SELECT source AS dimension, row_number() OVER (ORDER BY source) AS place, count(*) FILTER (quality = 1) AS n, 20 + 3 * count(*) FILTER (quality = 0) AS target FROM documents JOIN labels USING (doc_id) GROUP BY source"


@query(f"""WITH f AS ({_FILLS}), s AS (SELECT dimension, row_number() OVER (ORDER BY level, place) AS k FROM (SELECT *, unnest(range(n, target)) AS level FROM f)), i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents)
SELECT doc_id, dimension FROM i LEFT JOIN s USING (k)""")
def least_filled_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to the sources with the fewest good labelled ones, until each has its quota."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    fills = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("dimension")).agg(F.count_if(F.col("quality") == 1).alias("n"), (20 + 3 * F.count_if(F.col("quality") == 0)).alias("target"))
    from pyspark.sql import Window

    fills = fills.withColumn("place", F.row_number().over(Window.orderBy("dimension")))  # a row a source
    return synthesis.least_filled(d.select("doc_id"), "doc_id", fills).select("doc_id", "dimension")


@query(f"""WITH d AS (SELECT doc_id AS id, {corpus.DOMAIN} AS domain, {corpus.SUBDOMAIN} AS intent FROM documents), m AS (SELECT * FROM d WHERE id % 2 = 0 AND domain <> 'payslip' UNION ALL SELECT * FROM d WHERE id % 2 = 1),
r AS (SELECT id, intent, row_number() OVER (PARTITION BY intent ORDER BY md5(id::VARCHAR || '|split'), id) AS k, count(*) OVER (PARTITION BY intent) AS n FROM m) SELECT id, CASE WHEN n >= 10 AND k <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split, md5(id::VARCHAR || '|shuffle') AS shuffle FROM r""")
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as two runs, merged without the first one's payslip rows, split by intent; columns that a trainer doesn't read are dropped."""
    d = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "domain", F.col("subdomain").alias("intent"))
    merged = generation.merged_runs(d.where("id % 2 = 0"), d.where("id % 2 = 1"))
    return synthesis.split(merged, "intent", "id", 0.1, 10).withColumn("shuffle", generation.shuffle_key(F.col("id"))).drop("domain", "intent")


@query("""WITH r AS (SELECT event_type || '/' || user_id % 3 AS key, CASE WHEN user_id % 3 = 0 OR (user_id % 3 = 1 AND event_id % 2 = 0) THEN value > 50 END AS flag, CASE WHEN user_id % 3 = 1 AND event_id % 2 = 1 THEN value END AS number FROM events)
SELECT key, round(CASE WHEN count(flag) = count(*) THEN avg(flag::INT) ELSE avg(number) END, 6) AS mean FROM r GROUP BY key""")
def typed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose values are all flags, some numbers, or neither."""
    r = table(spark, sf_dir, "events").selectExpr("concat(event_type, '/', user_id % 3) AS key", "CASE WHEN user_id % 3 = 0 OR (user_id % 3 = 1 AND event_id % 2 = 0) THEN value > 50 END AS flag", "CASE WHEN user_id % 3 = 1 AND event_id % 2 = 1 THEN value END AS number")
    return generation.typed_mean(r)


@query(f"{S.ROUTED} SELECT id, expected, predicted FROM (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY id) AS n FROM r WHERE expected <> predicted) WHERE n <= 10")
def failure_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.first_failures(cut(S.routed(spark, sf_dir), "routed").where("expected <> predicted"), "expected", "id", 10)


@query(f"{S.GATED} SELECT domain, count(*) AS n, round(avg((id % 3 <> 0)::INT), 6) AS baseline, round(avg(((id % 3 <> 0) = sufficient)::INT), 6) AS rules FROM g GROUP BY GROUPING SETS ((domain), ())")
def gate_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the gate and of the gate that always says yes, against made-up expectations."""
    g = S.gated(spark, sf_dir).withColumn("rules", F.col("gate.sufficient"))
    g, right = generation.always_sufficient(g), F.col("id") % 3 != 0
    share = lambda c: F.round(F.avg((c == right).cast("int")), 6)
    return g.groupingSets([["domain"], []], "domain").agg(F.count(F.lit(1)).alias("n"), share(F.col("gate.sufficient")).alias("baseline"), share(F.col("rules")).alias("rules"))


@query(f"{corpus._knn_sql(3)} SELECT * FROM hits")
def index_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written as an index, read back and asked for three neighbours, with distances."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/vector-index-{uuid.uuid4().hex}"
    files.write_vectors(table(spark, sf_dir, "embeddings"), path)
    v = files.read_vectors(spark, path)
    return retrieve.knn(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3)


@query(f"""{REASONED}, chk AS (SELECT bool_and(decision IN ('ANSWER', 'ASK', 'ESCALATE')) AS a, bool_and(decision <> 'ASK' OR first_open IS NOT NULL) AS b, bool_and(decision <> 'ANSWER' OR failed > 0 OR first_open IS NULL OR NOT runs) AS c, bool_and(coverage BETWEEN 0 AND 1) AS d,
 bool_and(decision <> 'ESCALATE' OR met + failed + unresolved = 0) AS e FROM d)
SELECT unnest(['has decisions', 'asks have questions', 'answers have no question', 'coverage is a share', 'escalations have no conditions']) AS check_, unnest([a, b, c, d, e]) AS ok FROM chk""")
def smoke_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every resolution, as a row a check."""
    r = reasoned(spark, sf_dir).where("r IS NOT NULL").select("query_id", "r.*")
    every = lambda c: F.coalesce(F.every(c), F.lit(True))
    n = F.size("met") + F.size("failed") + F.size("unresolved")
    checks = {"has decisions": F.col("decision").isin("ANSWER", "ASK", "ESCALATE"), "asks have questions": (F.col("decision") != "ASK") | F.col("question").isNotNull(), "answers have no question": (F.col("decision") != "ANSWER") | F.col("question").isNull(),
              "coverage is a share": F.col("coverage").between(0, 1), "escalations have no conditions": (F.col("decision") != "ESCALATE") | (n == 0)}
    one = r.agg(*[every(c).alias(f"_{k}") for k, c in enumerate(checks.values())])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check_"), F.col(f"_{k}").alias("ok")) for k, name in enumerate(checks)])).alias("x")).select("x.*")
