"""Queries on questions: routing, slots, the gate, conditions, and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions import slots as S
from tessella.functions import tables as T
from tessella.operators import conversation, metrics
from tessella.plans import sql as Q
from tessella.plans.base import QUESTIONS_SQL, query, question_sql, questions, shared_dir, table

ASKED = f"WITH x AS (SELECT id, domain, lower(q) AS q FROM {QUESTIONS_SQL})"


@query(f"WITH x AS (SELECT conv_id, turn, lower(coalesce(text, '')) || ' ' || lower({question_sql('(conv_id * 7 + turn * 5)')}) AS q FROM conversations) SELECT conv_id, turn, {Q.route('q')} AS domain FROM x")
def keyword_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, with a question put behind it, goes to a domain."""
    t = table(spark, sf_dir, "conversations")
    q = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.expr(question_sql("(conv_id * 7 + turn * 5)")))
    return t.select("conv_id", "turn", q.alias("q")).select("conv_id", "turn", S.route(F.col("q")).alias("domain"))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", F.col("domain").alias("expected"), S.route(F.col("q")).alias("predicted"))


ROUTED = f"{ASKED}, r AS (SELECT id, domain AS expected, {Q.route('q')} AS predicted FROM x)"


@query(f"{ROUTED} SELECT expected, " + ", ".join(f"count(*) FILTER (predicted = '{d}') AS {d}" for d in T.DOMAINS) + " FROM r GROUP BY expected")
def router_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(routed(spark, sf_dir), T.DOMAINS)


@query(f"""{ROUTED}, c AS (SELECT class, count(*) FILTER (side = 't') AS support, count(*) FILTER (side = 'p') AS pred, count(*) FILTER (side = 't' AND expected = predicted) AS tp
FROM (SELECT *, expected AS class, 't' AS side FROM r UNION ALL SELECT *, predicted, 'p' FROM r) GROUP BY class),
pr AS (SELECT class, support, coalesce(tp / nullif(pred, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM c)
SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM pr""")
def router_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(routed(spark, sf_dir))


def _slots_of(domain: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return questions(spark, sf_dir).select("id", *S.extract(F.col("q"), domain))

    run.__name__ = f"slots_{domain}"
    run.__doc__ = f"The {domain} slots of every question, whatever its domain."
    return query(f"{ASKED} SELECT id, {', '.join(f'{e} AS {n}' for n, e in Q.slots(domain, 'q').items())} FROM x")(run)


for _d in T.DOMAINS:
    _slots_of(_d)


_ANSWER = "concat('```json{\"intent\": \"', CASE WHEN event_id % 5 = 0 THEN 'unheard_of' ELSE 'verify_epf' END, '\", \"basic_salary\": \"', cast(event_id % 50000 AS string), '.7\", \"state\": \" Goa \", \"gross_salary\": \"many\", \"k\": \"', replace(props, '\"', ''), '\"}```')"


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'general' ELSE 'verify_epf' END AS intent, event_id % 50000 AS basic_salary, NULL::BIGINT AS gross_salary, NULL::BIGINT AS epf_deducted, NULL::BIGINT AS esi_deducted, 'Goa' AS state, NULL::BIGINT AS employee_count FROM events")
def slot_validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots out of a model's JSON for every event."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(_ANSWER).alias("a")).select("event_id", *S.validated(F.col("a"), "payslip"))


def _as_map(names: list[str]) -> Column:
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])


@query(f"""{ASKED}, p AS (SELECT id, domain, {', '.join(f'CAST({e} AS VARCHAR) AS {n}' for n, e in Q.slots('payslip', 'q').items())} FROM x),
k AS (SELECT id, domain, k, CASE k {' '.join(f"WHEN '{n}' THEN {n}" for n in T.SLOTS['payslip'])} END AS p FROM p, (SELECT unnest([{', '.join(f"'{n}'" for n in T.SLOTS['payslip'])}]) AS k)),
e AS (SELECT id, domain, k, p, CASE WHEN k = 'intent' THEN CASE WHEN id % 9 = 0 THEN 'general' ELSE p END WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 AND k <> 'state' THEN CAST(try_cast(p AS BIGINT) + 1 AS VARCHAR) WHEN id % 4 = 0 AND k <> 'state' THEN CAST(try_cast(p AS BIGINT) + 2 AS VARCHAR) WHEN id % 11 = 0 THEN '77' ELSE p END AS e FROM k)
SELECT domain, count(DISTINCT id) AS n, round(coalesce(count(*) FILTER (k <> 'intent' AND e IS NOT NULL AND p IS NOT NULL) / nullif(count(*) FILTER (k <> 'intent' AND p IS NOT NULL), 0), 0), 6) AS precision,
 round(coalesce(count(*) FILTER (k <> 'intent' AND e IS NOT NULL AND p IS NOT NULL) / nullif(count(*) FILTER (k <> 'intent' AND e IS NOT NULL), 0), 0), 6) AS recall,
 round(coalesce(count(*) FILTER (k <> 'intent' AND CASE WHEN try_cast(e AS BIGINT) IS NOT NULL AND try_cast(p AS BIGINT) IS NOT NULL THEN abs(try_cast(e AS BIGINT) - try_cast(p AS BIGINT)) <= 1 ELSE lower(e) = lower(p) END) / nullif(count(*) FILTER (k <> 'intent' AND e IS NOT NULL AND p IS NOT NULL), 0), 0), 6) AS value_accuracy,
 round(coalesce(count(*) FILTER (k = 'intent' AND e = p) / nullif(count(*) FILTER (k = 'intent' AND e IS NOT NULL), 0), 0), 6) AS intent_accuracy
FROM e GROUP BY GROUPING SETS ((domain), ())""")
def slot_eval_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted payslip slots against expectations that are partly left out, off by one or two, or something else."""
    names = list(T.SLOTS["payslip"])
    p = questions(spark, sf_dir).select("id", "domain", *S.extract(F.col("q"), "payslip")).select("id", "domain", _as_map(names).alias("predicted"))
    off = lambda v, k: v.try_cast("long") + F.lit(k)
    expect = lambda k, v: (
        F.when(k == "intent", F.when(F.col("id") % 9 == 0, "general").otherwise(v)).when(F.col("id") % 7 == 0, F.lit(None)).when((F.col("id") % 5 == 0) & (k != "state"), off(v, 1).cast("string"))
        .when((F.col("id") % 4 == 0) & (k != "state"), off(v, 2).cast("string")).when(F.col("id") % 11 == 0, "77").otherwise(v))
    return metrics.slot_scores(p.select(F.col("id").alias("example_id"), "domain", F.transform_values("predicted", expect).alias("expected"), "predicted"))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain, slots, gate) of every question in its own domain."""
    q = questions(spark, sf_dir)
    m = F
    for d in T.DOMAINS:
        m = m.when(F.col("domain") == d, F.create_map(*[x for c, n in zip(S.extract(F.col("q"), d), T.SLOTS[d], strict=True) for x in (F.lit(n), c.cast("string"))]))
    return q.select("id", "domain", m.otherwise(None).alias("slots")).withColumn("gate", R.gate(F.col("slots"), F.col("domain")))


_LONG = " UNION ALL ".join(f"SELECT id, domain, unnest([{', '.join(chr(39) + n + chr(39) for n in T.SLOTS[d])}]) AS slot, unnest([{', '.join(f'CAST({e} AS VARCHAR)' for e in Q.slots(d, 'q').values())}]) AS v FROM x WHERE domain = '{d}'" for d in T.DOMAINS)
GATED = f"""{ASKED}, s AS ({_LONG}), i AS (SELECT id, domain, v AS intent FROM s WHERE slot = 'intent'),
m AS (SELECT i.id, list(need.slot ORDER BY need.pos) AS missing FROM i JOIN {Q.required()} ON need.intent = i.intent AND need.domain = i.domain JOIN s ON s.id = i.id AND s.slot = need.slot WHERE s.v IS NULL AND i.intent NOT IN ({', '.join(map(Q.text, T.CONTEXT_FREE_INTENTS))}) GROUP BY i.id),
g AS (SELECT i.id, i.domain, i.intent, m.missing IS NULL AS sufficient, m.missing FROM i LEFT JOIN m ON m.id = i.id)"""


@query(f"{GATED} SELECT g.id, domain, intent, sufficient, array_to_string(missing, ',') AS missing, q.question FROM g LEFT JOIN {Q.pairs(T.GATE_QUESTIONS, 'q(slot, question)')} ON q.slot = missing[1]")
def sufficiency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gated(spark, sf_dir)
    return g.select("id", "domain", F.col("slots")["intent"].alias("intent"), "gate.sufficient", F.when(~F.col("gate.sufficient"), F.array_join("gate.missing", ",")).alias("missing"), "gate.question")


@query(f"""{GATED}, e AS (SELECT *, id % 3 <> 0 AS expected, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'basic_salary' END AS want FROM g)
SELECT domain, count(*) AS n, round(avg((expected = sufficient)::INT), 6) AS accuracy, round(coalesce(count(*) FILTER (NOT expected AND sufficient) / nullif(count(*) FILTER (NOT expected), 0), 0), 6) AS false_sufficient,
round(coalesce(count(*) FILTER (expected AND NOT sufficient) / nullif(count(*) FILTER (expected), 0), 0), 6) AS false_insufficient,
round(coalesce(count(*) FILTER (NOT expected AND NOT sufficient AND want = missing[1]) / nullif(count(*) FILTER (NOT expected AND NOT sufficient AND want IS NOT NULL), 0), 0), 6) AS missing_slot_accuracy
FROM e GROUP BY GROUPING SETS ((domain), ())""")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate against made-up expectations."""
    g = gated(spark, sf_dir)
    return metrics.gate_scores(g.select("domain", (F.col("id") % 3 != 0).alias("expected"), F.col("gate.sufficient").alias("sufficient"), F.when((F.col("id") % 3 == 0) & (F.col("id") % 2 == 0), "basic_salary").alias("expected_missing"), F.get("gate.missing", 0).alias("first_missing")))


#: Conditions in the knowledge base's grammar, with whether they are mandatory. Written for these queries.
CONDITIONS = (("service_years >= 5", True), ("age < 58", True), ("kyc_status == verified", True), ("employment_status is known", True), ("balance > 1000", False), ("balance <= 9000", True))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, domain, place, field, operator, value, slot_value, status, mandatory): every customer's made-up slots against CONDITIONS; domain is the market segment."""
    c = table(spark, sf_dir, "customer")
    text = lambda x: x.cast("string")
    slots = F.create_map(
        F.lit("service_years"), F.when(F.col("c_custkey") % 7 != 0, text(F.col("c_custkey") % 12)), F.lit("age"), text(F.col("c_custkey") % 80),
        F.lit("kyc_status"), F.when(F.col("c_custkey") % 3 == 0, "complete").when(F.col("c_custkey") % 3 == 1, " Done "), F.lit("balance"), F.when(F.col("c_custkey") % 5 != 0, text(F.floor("c_acctbal"))),
        F.lit("employment_status"), F.when(F.col("c_custkey") % 2 == 0, "retired"))
    conds = F.array(*[F.struct(F.lit(n).alias("place"), R.parsed_condition(F.lit(t)).alias("c"), F.lit(m).alias("mandatory")) for n, (t, m) in enumerate(CONDITIONS)])
    one = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("domain"), slots.alias("slots"), F.explode(conds).alias("x"))
    value = F.try_element_at(F.col("slots"), F.col("x.c.field"))
    return one.select("id", "domain", "x.place", "x.c.field", "x.c.operator", "x.c.value", value.alias("slot_value"), R.status(value, F.col("x.c.operator"), F.col("x.c.value")).alias("status"), "x.mandatory")


CHECKED = """WITH s AS (SELECT c_custkey AS id, c_mktsegment AS domain, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 12 END AS y, c_custkey % 80 AS a, CASE c_custkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN ' Done ' END AS k,
 CASE WHEN c_custkey % 5 <> 0 THEN floor(c_acctbal)::BIGINT END AS b, CASE WHEN c_custkey % 2 = 0 THEN 'retired' END AS e FROM customer),
c AS (SELECT id, domain, 0 AS place, 'service_years' AS field, 'gte' AS operator, '5' AS value, y::VARCHAR AS slot_value, y >= 5 AS met, true AS mandatory FROM s
 UNION ALL SELECT id, domain, 1, 'age', 'lt', '58', a::VARCHAR, a < 58, true FROM s UNION ALL SELECT id, domain, 2, 'kyc_status', 'eq', 'verified', k, lower(trim(k)) IN ('complete', 'done'), true FROM s
 UNION ALL SELECT id, domain, 3, 'employment_status', 'not_null', NULL, e, CASE WHEN e IS NOT NULL THEN true END, true FROM s UNION ALL SELECT id, domain, 4, 'balance', 'gt', '1000', b::VARCHAR, b > 1000, false FROM s
 UNION ALL SELECT id, domain, 5, 'balance', 'lte', '9000', b::VARCHAR, b <= 9000, true FROM s),
st AS (SELECT *, CASE WHEN met IS NULL THEN 'UNRESOLVED' WHEN met THEN 'RESOLVED_MET' ELSE 'RESOLVED_NOT_MET' END AS status FROM c)"""


@query(f"{CHECKED} SELECT id, place, field, operator, value, slot_value, status, mandatory FROM st")
def condition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).drop("domain")


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checked(spark, sf_dir).groupBy("id", "domain").agg(F.array_sort(F.collect_list(F.struct("place", "field", "status", "mandatory"))).alias("c"))
    return c.select("id", "domain", R.resolved(F.col("c")).alias("r"))


RESOLVED = f"""{CHECKED}, r AS (SELECT id, domain, count(*) FILTER (mandatory AND status = 'RESOLVED_MET') AS met, count(*) FILTER (mandatory AND status = 'RESOLVED_NOT_MET') AS failed, count(*) FILTER (mandatory AND status = 'UNRESOLVED') AS unresolved,
 count(*) FILTER (NOT mandatory AND status = 'RESOLVED_MET') AS warnings, min(place) FILTER (mandatory AND status = 'UNRESOLVED') AS first FROM st GROUP BY id, domain),
o AS (SELECT r.*, CASE WHEN failed > 0 THEN 'ANSWER' WHEN unresolved > 0 THEN 'ASK' ELSE 'ANSWER' END AS decision, CASE WHEN failed > 0 THEN false WHEN unresolved > 0 THEN NULL ELSE true END AS eligible,
 CASE WHEN failed = 0 THEN first END AS ask, round_even((met + failed) / (met + failed + unresolved), 2) AS coverage FROM r)"""


@query(f"""{RESOLVED} SELECT o.id, decision, eligible, coverage, met, failed, unresolved, warnings,
 coalesce(q.question, CASE WHEN f.field IS NOT NULL THEN 'Could you provide your ' || replace(f.field, '_', ' ') || '?' END) AS question
 FROM o LEFT JOIN (SELECT DISTINCT place, field FROM st) f ON f.place = o.ask LEFT JOIN {Q.pairs(T.REASONER_QUESTIONS, 'q(field, question)')} ON q.field = f.field""")
def resolve_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolutions(spark, sf_dir)
    return r.select("id", "r.decision", "r.eligible", "r.coverage", *[F.size(f"r.{n}").cast("long").alias(n) for n in ("met", "failed", "unresolved", "warnings")], "r.question")


@query(f"{RESOLVED} SELECT domain, count(*) AS n, round(avg(coverage), 6) AS coverage FROM o GROUP BY GROUPING SETS ((domain), ())")
def coverage_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolutions(spark, sf_dir).groupingSets([["domain"], []], "domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r.coverage"), 6).alias("coverage"))


TURN = "(conv_id * 7 + turn - turn % 3)"
SLOT_NAMES = ["intent", "employment_status", "service_years", "state"]


def turns(messages: DataFrame) -> DataFrame:
    """(session, turn, domain and four slots): messages as turns of a made-up dialogue; three turns in a row have one question."""
    q = messages.withColumn("q", F.lower(F.expr(question_sql(TURN))))
    odd = lambda c, k: F.when((F.col("conv_id") + F.col("turn")) % k != 0, c)
    return q.select(F.col("conv_id").alias("session"), "turn", S.route(F.col("q")).alias("domain"), odd(S.pf(F.col("q"))["intent"], 4).alias("intent"), odd(S.pf(F.col("q"))["employment_status"], 3).alias("employment_status"), S.years(F.col("q")).cast("string").alias("service_years"), odd(S.state(F.col("q")), 5).alias("state"))


_PF = Q.slots("pf", "q")
MERGED = f"""WITH x AS (SELECT conv_id, turn, lower({question_sql(TURN)}) AS q FROM conversations), t AS (SELECT conv_id AS session, turn, {Q.route('q')} AS domain, CASE WHEN (conv_id + turn) % 4 <> 0 THEN {_PF['intent']} END AS intent,
 CASE WHEN (conv_id + turn) % 3 <> 0 THEN {_PF['employment_status']} END AS employment_status, CAST({Q.years('q')} AS VARCHAR) AS service_years, CASE WHEN (conv_id + turn) % 5 <> 0 THEN {Q.state('q')} END AS state FROM x),
l AS (SELECT *, lag(domain) OVER (PARTITION BY session ORDER BY turn) AS was, row_number() OVER (PARTITION BY session ORDER BY turn) AS n FROM t),
g AS (SELECT *, sum((n > 1 AND domain <> was)::INT) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seg FROM l)
SELECT session, turn, domain, first_value(intent IGNORE NULLS) OVER w AS intent, first_value(employment_status IGNORE NULLS) OVER w AS employment_status, last_value(service_years IGNORE NULLS) OVER w AS service_years, last_value(state IGNORE NULLS) OVER w AS state
FROM g WINDOW w AS (PARTITION BY session, seg ORDER BY turn ROWS UNBOUNDED PRECEDING)"""


@query(MERGED)
def slot_merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.merged(turns(table(spark, sf_dir, "conversations")), "session", "turn", SLOT_NAMES).drop("segment")


@query(MERGED)
def stream_slot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as slot_merge_turns, as a stream with keyed state over the whole table."""
    from tessella.streaming import state

    source = table(spark, sf_dir, "conversations")
    rows = spark.readStream.schema(source.schema).format("parquet").option("maxFilesPerTrigger", 10_000).load(f"{sf_dir}/conversations.parque[t]")  # a pattern, as the table may be a file or a folder
    return state.run_once(spark, state.slot_stream(turns(rows), SLOT_NAMES), shared_dir(spark))


@query("""SELECT conv_id, turn, coalesce(array_to_string(list_reverse(list_filter([lag(m, 1) OVER w, lag(m, 2) OVER w, lag(m, 3) OVER w, lag(m, 4) OVER w], lambda v: v IS NOT NULL)), chr(10)), '') AS history
FROM (SELECT conv_id, turn, upper(role) || ': ' || coalesce(text, '') AS m FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def history_last4(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    h = conversation.history(t, "conv_id", "turn", "role", "text")
    return h.select("conv_id", "turn", F.array_join(F.transform("history", lambda m: F.concat_ws(": ", F.upper(m["role"]), m["text"])), "\n").alias("history"))


SALARIES = "c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN 6000 + (c_custkey * 37) % 30000 END AS basic_salary, CASE WHEN c_custkey % 6 <> 0 THEN 7000 + (c_custkey * 53) % 40000 END AS gross_salary, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1800 WHEN 2 THEN 2400 ELSE (c_custkey * 37) % 4000 END AS epf_deducted, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE (c_custkey * 13) % 300 END AS esi_deducted"
STATES = [*T.PT_SLABS, *T.PT_EXEMPT_STATES, "Assam"]
_STATE = "CASE " + " ".join(f"WHEN c_custkey % {len(STATES) + 1} = {k} THEN '{s}'" for k, s in enumerate(STATES)) + " END"
PT_VALUES = "(VALUES " + ", ".join([f"('{s}', -1, 9e15, 0)" for s in T.PT_EXEMPT_STATES] + [f"('{s}', {low}, {high if high is not None else 9e15}, {amount})" for s, slabs in T.PT_SLABS.items() for low, (high, amount) in zip([-1, *[h for h, _ in slabs]], slabs, strict=False)]) + ") AS pt(state, low, high, amount)"


def salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").selectExpr(*[e.strip() for e in _columns(SALARIES)], f"{_STATE} AS state")
    return c.select("id", *[F.col(n).cast("long").alias(n) for n in ("basic_salary", "gross_salary", "epf_deducted", "esi_deducted")], "state")


def _columns(s: str) -> list[str]:
    return [p for p in s.replace(", CASE", "\nCASE").split("\n")]


SALARIED = f"WITH s AS (SELECT {SALARIES}, {_STATE} AS state FROM customer), b AS (SELECT *, coalesce(gross_salary, basic_salary) AS sal FROM s), p AS (SELECT b.*, pt.amount AS pt FROM b LEFT JOIN {PT_VALUES} ON pt.state = b.state AND sal > pt.low AND sal <= pt.high)"


@query(f"{SALARIED} SELECT id, state, sal::BIGINT AS salary, pt::BIGINT AS pt FROM p")
def pt_slab_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = salaries(spark, sf_dir).withColumn("salary", F.coalesce("gross_salary", "basic_salary"))
    return R.with_pt(s, F.col("salary"), F.col("state")).select("id", "state", "salary", "pt")


_VERDICT = "CASE WHEN {a} IS NULL THEN 'NO_ACTUAL' WHEN abs({a} - {e}) <= 1 THEN 'CORRECT' WHEN {a} < {e} THEN 'UNDER_DEDUCTED' ELSE 'OVER_DEDUCTED' END"


@query(f"""{SALARIED}, d AS (SELECT *, round_even(basic_salary * 0.12::DOUBLE, 0)::BIGINT AS epf, CASE WHEN sal <= 21000 THEN round_even(sal * 0.0075::DOUBLE, 0)::BIGINT ELSE 0 END AS esi FROM p)
SELECT id, 'EPF' AS kind, epf AS expected, epf_deducted::BIGINT AS actual, {_VERDICT.format(a='epf_deducted', e='epf')} AS verdict FROM d WHERE basic_salary IS NOT NULL
UNION ALL SELECT id, 'ESI', esi, esi_deducted, CASE WHEN sal <= 21000 THEN {_VERDICT.format(a='esi_deducted', e='esi')} WHEN esi_deducted IS NULL THEN 'NOT_APPLICABLE' WHEN esi_deducted = 0 THEN 'CORRECT' ELSE 'SHOULD_NOT_DEDUCT' END FROM d WHERE sal IS NOT NULL
UNION ALL SELECT id, 'Professional Tax', pt, NULL, CASE WHEN pt IS NULL THEN 'CANNOT_COMPUTE' ELSE 'COMPUTED' END FROM d WHERE sal IS NOT NULL""")
def payslip_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit(salaries(spark, sf_dir)).select("id", "kind", "expected", "actual", "verdict")


@query("""WITH o AS (SELECT o_orderkey AS id, round(o_totalprice)::BIGINT AS amount, o_orderkey % 30 AS years, o_orderkey % 3 = 0 AS metro, CASE WHEN o_orderkey % 2 = 0 THEN 'old_regime' ELSE 'new_regime' END AS regime FROM orders)
SELECT id, CASE WHEN years >= 5 THEN trunc(amount * 15 * years / 26)::BIGINT ELSE 0 END AS gratuity, amount - round_even((amount // 12) * 0.1::DOUBLE, 0)::BIGINT AS rent_less_tenth, round_even((amount // 12) * CASE WHEN metro THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END, 0)::BIGINT AS share_of_basic,
CASE WHEN regime = 'new_regime' THEN 0 ELSE least(amount, 150000) END AS claimable_80c, CASE WHEN years >= 5 OR amount <= 50000 THEN 0 ELSE round_even(amount * 0.1::DOUBLE, 0)::BIGINT END AS tds FROM o""")
def gratuity_hra_80c_tds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").alias("amount"), (F.col("o_orderkey") % 30).alias("years"), (F.col("o_orderkey") % 3 == 0).alias("metro"), F.when(F.col("o_orderkey") % 2 == 0, "old_regime").otherwise("new_regime").alias("regime"))
    hra = R.hra_parts(F.floor(F.col("amount") / 12), F.col("amount"), F.col("metro"))
    return o.select("id", R.gratuity(F.col("amount"), F.col("years")).alias("gratuity"), *[c.alias(n) for n, c in hra.items()], R.section_80c(F.col("amount"), F.col("regime")).alias("claimable_80c"), R.tds_on_withdrawal(F.col("amount"), F.col("years")).alias("tds"))
