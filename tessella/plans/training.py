"""Queries on training data, quality figures and events, and the whole question-answering plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import answers as A
from tessella.functions import slots as S
from tessella.functions import tables as T
from tessella.functions import text as X
from tessella.operators import endpoints, metrics, retrieve, synthesis
from tessella.plans import answering, corpus
from tessella.plans import sql as Q
from tessella.plans.base import QUESTIONS_SQL, query, questions, spread, table
from tessella.streaming import state

#: An answer out of a document: its text with citations and a verdict put in by its id.
ANSWER = "concat(coalesce(text, ''), CASE doc_id % 4 WHEN 0 THEN '' ELSE concat(' [DOC_', cast(doc_id % 9 AS string), '] and [DOC_', cast(doc_id % 5 AS string), ']') END, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' You are Not eligible, however.' WHEN 2 THEN ' The amount matches expected pay.' WHEN 3 THEN ' It is incorrect under section 7.' WHEN 4 THEN ' I cannot help: outside my scope.' ELSE ' You are eligible after the 5-year rule, Applicable: Yes.' END)"
_A = f"WITH x AS (SELECT doc_id, lang, {ANSWER} AS t FROM documents)"
CITED_SQL = "list_distinct(regexp_extract_all(t, '\\[([A-Z][A-Z0-9_]+)\\]', 1))"
WORDS_SQL = r"len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> ''))"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, t, allowed)."""
    allowed = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 7).cast("int")), lambda i: F.concat(F.lit("DOC_"), i))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr(ANSWER).alias("t"), allowed.alias("allowed"))


ALLOWED_SQL = "list_transform(range(0, doc_id % 7 + 1), lambda i: 'DOC_' || i)"
_AUDIT = f"{_A}, c AS (SELECT *, {CITED_SQL} AS cited, {ALLOWED_SQL} AS allowed FROM x), f AS (SELECT *, list_sort(list_filter(cited, lambda q: NOT list_contains(allowed, q))) AS made_up FROM c)"


@query(f"{_AUDIT} SELECT doc_id, len(cited)::INT AS cited, array_to_string(made_up, ',') AS made_up FROM f")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answers(spark, sf_dir).withColumn("cited", X.citations(F.col("t")))
    return a.select("doc_id", F.size("cited").alias("cited"), F.array_join(F.array_sort(F.array_except("cited", "allowed")), ",").alias("made_up"))


_VERDICTS = tuple(T.VERDICT_WORDS)
_EXPECT = "CASE " + " ".join(f"WHEN doc_id % {len(_VERDICTS)} = {k} THEN {Q.text(v)}" for k, v in enumerate(_VERDICTS)) + " END"
_WORDS_OK = "CASE " + " ".join(f"WHEN expected = {Q.text(v)} THEN {Q.any_of('lower(t)', ws)}" for v, ws in T.VERDICT_WORDS.items()) + " END"


@query(f"""{_AUDIT}, s AS (SELECT *, {_EXPECT} AS expected FROM f), v AS (SELECT *, {_WORDS_OK} AS ok, CASE WHEN doc_id % 3 <> 0 THEN (contains(lower(t), 'the')::INT + contains(lower(t), 'section')::INT) / 2 END AS kf FROM s)
SELECT lang AS domain, count(*) AS n, round(avg((len(cited) > 0)::INT), 6) AS citation_coverage, count(*) FILTER (len(made_up) > 0) AS fabrications, round(avg((len(made_up) > 0)::INT), 6) AS fabrication_rate,
round(avg(list_contains(cited, 'DOC_' || (doc_id % 9))::INT), 6) AS expected_cites_hit, round(avg(ok::INT), 6) AS verdict_accuracy, round(avg((len(cited) > 0 AND len(made_up) = 0 AND ok)::INT), 6) AS grounded_clean, round(sum(coalesce(kf, 0)) / greatest(1, count(kf)), 6) AS key_facts_mean
FROM v GROUP BY GROUPING SETS ((lang), ())""")
def response_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.scorecard(scored(answers(spark, sf_dir).withColumn("expected", F.expr(_EXPECT)).withColumn("wanted", F.array(F.concat(F.lit("DOC_"), F.col("doc_id") % 9)))
                                    .withColumn("facts", F.when(F.col("doc_id") % 3 != 0, F.array(F.lit("The"), F.lit("section")))).withColumnRenamed("lang", "domain")))


def scored(a: DataFrame) -> DataFrame:
    """Answers (t, allowed, expected verdict, wanted citations, key facts) with what is right about them."""
    cited, low = X.citations(F.col("t")), F.lower("t")
    ok = F
    for v, words in T.VERDICT_WORDS.items():
        ok = ok.when(F.col("expected") == v, X.has_any(low, words))
    ok = ok.otherwise(F.contains(low, F.col("expected")))
    made_up = F.size(F.array_except(cited, "allowed")) > 0
    facts = F.when(F.size("facts") > 0, F.size(F.filter("facts", lambda f: F.contains(low, F.lower(f)))) / F.size("facts"))
    return a.select("*", (F.size(cited) > 0).alias("has_citation"), made_up.alias("has_fabrication"), (F.size(F.array_except("wanted", cited)) == 0).alias("expected_cited"), ok.alias("verdict_ok"),
                    ((F.size(cited) > 0) & ~made_up & ok).alias("grounded_clean"), facts.alias("key_facts_rate"))


@query(f"""{_AUDIT}, w AS (SELECT *, {WORDS_SQL} AS n, lower(t) AS low FROM f) SELECT doc_id, CASE WHEN n < 60 THEN 'too short' WHEN n > 450 THEN 'too long' {' '.join(f"WHEN contains(low, {Q.text(p)}) THEN {Q.text(f'refusal: {chr(39)}{p}{chr(39)}')}" for p in T.SFT_REFUSALS)}
WHEN len(cited) = 0 THEN 'no citations' WHEN len(made_up) > 0 THEN 'fabricated cites: ' || array_to_string(made_up[1:3], ', ') WHEN NOT {Q.any_of('low', T.SFT_VERDICTS)} THEN 'no verdict keyword' ELSE 'ok' END AS reason FROM w""")
def sft_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", synthesis.sft_reason(F.col("t"), F.col("allowed")).alias("reason"))


_DIMENSION = "CASE doc_id % 3 WHEN 0 THEN 'verdict_correctness' WHEN 1 THEN 'refusal_and_escalation' ELSE 'citation' END"


@query(f"""{_AUDIT}, w AS (SELECT *, {WORDS_SQL} AS n, lower(t) AS low, {_DIMENSION} AS d FROM f) SELECT doc_id, CASE WHEN n < 40 THEN 'chosen too short' WHEN n > 550 THEN 'chosen too long' WHEN d = 'refusal_and_escalation' AND NOT {Q.any_of('low', T.DPO_REFUSAL_SIGNALS)} THEN 'chosen missing refusal/escalation signal'
WHEN d = 'refusal_and_escalation' THEN 'ok' {' '.join(f"WHEN contains(low, {Q.text(p)}) THEN {Q.text('chosen accidental refusal: ' + p)}" for p in T.DPO_REFUSALS)} WHEN len(cited) = 0 THEN 'chosen no citations'
WHEN len(made_up) > 0 THEN 'chosen fabricated cites: ' || array_to_string(made_up[1:2], ', ') WHEN NOT {Q.any_of('low', T.DPO_VERDICTS)} THEN 'chosen no verdict keyword' ELSE 'ok' END AS reason FROM w""")
def dpo_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", synthesis.chosen_reason(F.col("t"), F.col("allowed"), F.expr(_DIMENSION)).alias("reason"))


def _split_sql(source: str, stratum: str, key: str, share: str, least: int) -> str:
    return f"""WITH r AS (SELECT {key} AS id, {stratum} AS stratum, row_number() OVER (PARTITION BY {stratum} ORDER BY md5({key}::VARCHAR || '|split'), {key}) AS k, count(*) OVER (PARTITION BY {stratum}) AS n FROM {source})
SELECT id, stratum, CASE WHEN n >= {least} AND k <= greatest(1, floor(n * {share}::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r"""


@query(_split_sql("documents", "concat(lang, '/', source)", "doc_id", "0.1", 10))
def stratified_split_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("lang", F.lit("/"), "source").alias("stratum"))
    return synthesis.split(d, "stratum", "id", 0.1, 10)


@query(_split_sql("labels", "quality", "doc_id", "0.15", 1))
def stratified_split_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.split(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("stratum")), "stratum", "id", 0.15, 1)


@query("SELECT source, lang, count(*) AS docs, least(20, count(*) * 10) AS budget FROM documents GROUP BY source, lang")
def subdomain_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"))
    return d.withColumn("budget", synthesis.budget(F.col("docs")))


@query("""WITH r AS (SELECT event_type, row_number() OVER w AS n, sum((value < 20 + (event_id % 100))::INT) OVER w AS r FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_type, min(n) FILTER (n >= 50 AND r / n > 0.4) AS stopped_at, count(*) AS attempts FROM r GROUP BY event_type""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts of a generator, by type."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("value") < 20 + F.col("event_id") % 100).alias("rejected"))
    return synthesis.breaker(e, "event_type", "event_id")


def _draw(key: str, name: str, n: int) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '|{name}'), 1, 7))::BIGINT % {n})"


def _choice(key: str, name: str, values: tuple) -> str:
    return f"([{', '.join(map(str, values))}])[{_draw(key, name, len(values))} + 1]"


_PAY = f"""WITH b AS (SELECT c_custkey AS id, {_choice('c_custkey', 'basic', (9000, 12000, 15000, 18000, 22000, 30000))} AS basic, {_choice('c_custkey', 'extra', (3000, 5000, 7000, 10000))} AS extra FROM customer),
g AS (SELECT id, basic, basic + extra AS gross, round_even(basic * 0.12::DOUBLE, 0)::BIGINT AS due, CASE WHEN basic + extra <= 21000 THEN round_even((basic + extra) * 0.0075::DOUBLE, 0)::BIGINT ELSE 0 END AS due_esi FROM b),
s AS (SELECT id, basic::BIGINT AS basic_salary, gross::BIGINT AS gross_salary, CASE WHEN {_draw('id', 'epf_ok', 100)} < 60 THEN due ELSE due + {_choice('id', 'epf_off', (-600, -300, 300, 600))} END AS epf_deducted,
 CASE WHEN {_draw('id', 'esi_ok', 100)} < 60 OR gross > 21000 THEN due_esi ELSE due_esi + {_choice('id', 'esi_off', (-50, 50, 100))} END AS esi_deducted FROM g)"""


def customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.payslip_slots(customer_ids(spark, sf_dir), "id")


@query(f"{_PAY} SELECT * FROM s")
def slot_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir)


def slot_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(spark, sf_dir).select("id", F.create_map(*[x for n in ("gross_salary", "basic_salary", "epf_deducted") for x in (F.lit(n), F.when((F.col("id") % 7 != 0) | F.lit(n != "epf_deducted"), F.col(n).cast("string")))]).alias("m"))


@query(f"{_PAY} SELECT id, CASE WHEN id % 7 <> 0 THEN 'Is ' || epf_deducted || ' right for a basic salary of ' || basic_salary || ' and ' || gross_salary || ' gross?' END AS q FROM s")
def query_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions out of a template; null where a slot is missing."""
    return slot_maps(spark, sf_dir).select("id", X.fill(F.lit("Is {epf_deducted} right for a basic salary of {basic_salary} and {gross_salary} gross?"), F.col("m")).alias("q"))


@query(f"{_PAY} SELECT id, 'basic_salary=' || basic_salary || CASE WHEN id % 7 <> 0 THEN '|epf_deducted=' || epf_deducted ELSE '' END || '|gross_salary=' || gross_salary AS k FROM s")
def slot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = slot_maps(spark, sf_dir)
    return m.select("id", X.slot_key(F.map_filter("m", lambda _, v: v.isNotNull())).alias("k"))


def _flipped(c: str) -> str:
    opposite = "MAP {" + ", ".join(f"{Q.text(k)}: {Q.text(v)}" for k, v in T.OPPOSITES.items()) + "}"
    parts, said = f"regexp_split_to_array({c}, {Q.text(T.VERDICT)})", f"regexp_extract_all({c}, {Q.text(T.VERDICT)})"
    return f"array_to_string(list_transform(list_zip({parts}, {said}), lambda z: z[1] || coalesce({opposite}[z[2]], '')), '')"


_THERE = "list_filter([" + ", ".join(f"CASE WHEN contains(f, {Q.text(p)}) THEN {{'old': {Q.text(p)}, 'new': {_choice('doc_id', f'wrong{n}', tuple(map(Q.text, ps)))}}} END" for n, (p, ps) in enumerate(T.WRONG_THRESHOLDS)) + "], lambda x: x IS NOT NULL)"


@query(f"""{_A}, f AS (SELECT doc_id, {_flipped('t')} AS f FROM x), h AS (SELECT *, {_THERE} AS there FROM f), o AS (SELECT *, there[(('0x' || substr(md5(doc_id::VARCHAR || '|threshold'), 1, 7))::BIGINT % greatest(len(there), 1)) + 1] AS one FROM h)
SELECT doc_id, md5(CASE WHEN one IS NULL THEN f ELSE substr(f, 1, instr(f, one.old) - 1) || one.new || substr(f, instr(f, one.old) + length(one.old)) END) AS digest FROM o""")
def verdict_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", F.md5(synthesis.flip_verdict(F.col("t"), F.col("doc_id"))).alias("digest"))


_RULE = "CASE " + " ".join(f"WHEN {_draw('doc_id', 'rule', len(T.INVENTED_RULES))} = {n} THEN replace(replace(replace({Q.text(f)}, '{{a}}', {_choice('doc_id', f'a{n}', tuple(map(Q.text, a)))}), '{{b}}', {_choice('doc_id', f'b{n}', tuple(map(Q.text, b)))}), '{{cite}}', cite)" for n, (f, a, b) in enumerate(T.INVENTED_RULES)) + " END"


@query(f"""{_A}, c AS (SELECT *, ({ALLOWED_SQL})[(('0x' || substr(md5(doc_id::VARCHAR || '|cite'), 1, 7))::BIGINT % (doc_id % 7 + 1)) + 1] AS cite, string_split(t, chr(10)) AS l FROM x), r AS (SELECT *, {_RULE} AS rule, greatest(3, len(l) - 4) AS cut FROM c)
SELECT doc_id, md5(CASE WHEN len(l) > 4 THEN array_to_string(l[1:cut], chr(10)) || rule || chr(10) || array_to_string(l[cut + 1:], chr(10)) ELSE t || rule END) AS digest FROM r""")
def grounding_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", F.md5(synthesis.inject_rule(F.col("t"), F.col("allowed"), F.col("doc_id"))).alias("digest"))


@query()
def citation_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with each citation changed to another; choices depend on places in the text, so tested by their properties."""
    return answers(spark, sf_dir).select("doc_id", synthesis.permute_citations(F.col("t"), F.col("allowed"), F.col("doc_id")).alias("t"))




@query("""WITH s AS (SELECT c_custkey AS id, c_custkey % 12 >= 5 AS a, c_custkey % 80 < 58 AS b, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 = 1 END AS c, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey % 3 = 0 END AS d FROM customer),
k AS (SELECT *, a::INT + b::INT + coalesce(c, false)::INT + coalesce(d, false)::INT AS met, (NOT a)::INT + (NOT b)::INT + coalesce(NOT d, false)::INT AS failed, (c IS NULL)::INT + (d IS NULL)::INT AS open FROM s)
SELECT id, 'ANSWER' AS decision, failed = 0 AS eligible, round_even(met / (met + failed + open), 2) AS coverage FROM k WHERE met + failed > 0 UNION ALL SELECT id, 'ASK', NULL, NULL FROM k WHERE met + failed = 0 AND open > 0""")
def trace_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    cond = lambda met, mandatory: F.struct(met.alias("met"), F.lit(mandatory).alias("mandatory"))
    conds = F.array(cond(c % 12 >= 5, True), cond(c % 80 < 58, True), cond(F.when(c % 4 != 0, c % 4 == 1), False), cond(F.when(c % 3 != 2, c % 3 == 0), True))
    return table(spark, sf_dir, "customer").select(c.alias("id"), synthesis.trace(conds).alias("r")).select("id", "r.*")


def two_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, base_ok, system_ok): the router against always answering pf. The question is one value of the router's: a filter on the verdict, which the optimizer
    moves below this step, would otherwise put the question's whole expression in place of every keyword's look at it."""
    q = questions(spark, sf_dir)
    return q.select("id", "domain", (F.col("domain") == "pf").alias("base_ok"), (F.col("domain") == X.once(F.col("q"), S.route)).alias("system_ok"))


_TWO = f"WITH x AS (SELECT id, domain, lower(q) AS q FROM {QUESTIONS_SQL}), t AS (SELECT id, domain, domain = 'pf' AS base_ok, domain = {Q.route('q')} AS system_ok FROM x)"


@query(f"{_TWO} SELECT domain AS metric, round(avg(base_ok::INT), 6) AS base, round(avg(system_ok::INT), 6) AS system, round(round(avg(system_ok::INT), 6) - round(avg(base_ok::INT), 6), 6) AS delta FROM t GROUP BY domain")
def metric_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.deltas(by_system(spark, sf_dir), "always_pf", "router")


def by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.explode(F.array(F.struct(F.lit("always_pf").alias("system"), F.col("base_ok").alias("ok")), F.struct(F.lit("router").alias("system"), F.col("system_ok").alias("ok"))))
    return two_systems(spark, sf_dir).select(F.col("domain").alias("metric"), sides.alias("s")).groupBy("metric", "s.system").agg(F.round(F.avg(F.col("s.ok").cast("int")), 6).alias("value"))


@query(f"{_TWO} SELECT id, CASE WHEN system_ok THEN 'fixed' ELSE 'broken' END AS change FROM t WHERE base_ok <> system_ok")
def fixed_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.fixed_and_broken(two_systems(spark, sf_dir))


@query(f"{_TWO}, m AS (SELECT domain, round(avg(base_ok::INT), 6) AS b, round(avg(system_ok::INT), 6) AS s FROM t GROUP BY domain) SELECT domain AS metric, CASE WHEN s > b THEN 'router' ELSE 'always_pf' END AS winner, greatest(b, s) AS value FROM m")
def winner_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.winner(by_system(spark, sf_dir), "always_pf")


@query("""WITH s AS (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'sft' ELSE 'dpo' END AS system, round_even(coalesce(CASE WHEN doc_id % 7 <> 0 THEN 1 + (doc_id + quality * 2) % 5 END, 3) / 5, 2) AS score FROM labels JOIN documents USING (doc_id)),
g AS (SELECT lang AS domain, round(avg(score) FILTER (system = 'sft'), 6) AS sft, round(avg(score) FILTER (system = 'dpo'), 6) AS dpo FROM s GROUP BY GROUPING SETS ((lang), ())) SELECT domain, sft, dpo, round(dpo - sft, 6) AS delta FROM g""")
def judge_means_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    score = F.when(F.col("doc_id") % 7 != 0, 1 + (F.col("doc_id") + F.col("quality") * 2) % 5)
    return metrics.judge_means(l.select(F.col("lang").alias("domain"), F.when(F.col("doc_id") % 2 == 0, "sft").otherwise("dpo").alias("system"), score.alias("score")), ("sft", "dpo"))


@query("SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_times(state.windowed(table(spark, sf_dir, "events"), "1 day"))


def _text_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, t in df.dtypes if t == "timestamp"})


@query("SELECT (date_trunc('hour', ts) - INTERVAL (h) HOUR)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events, (VALUES (0), (1)) AS v(h) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_times(state.windowed(table(spark, sf_dir, "events"), "2 hours", "1 hour"))


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events), s AS (SELECT *, sum((was IS NULL OR ts - was >= INTERVAL 6 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_times(state.sessions(table(spark, sf_dir, "events"), "6 hours"))


@query()
def rag_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item through the whole plan with the default endpoints: route, the domain's own slots, gate, retrieval, domain order, conditions, prompt, answer, score."""
    out = answering.answers(spark, sf_dir, corpus.asked(spark, sf_dir).withColumnRenamed("text", "question")).withColumnRenamed("response", "answer")
    cited = X.citations("answer")
    return out.select("query_id", "domain", "decision", "answer", F.size(cited).alias("cited"), F.size(F.array_except(cited, "doc_ids")).alias("made_up"))


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template answers for every customer's sampled payslip, with two or three documents to cite."""
    s = synthesis.payslip_slots(spread(customer_ids(spark, sf_dir), "id"), "id").withColumn("intent", synthesis.choice(F.col("id"), "intent", tuple(synthesis.ANSWERS)))
    docs = F.transform(F.sequence(F.lit(0), F.lit(1) + F.pmod(F.col("id"), F.lit(2)).cast("int")), lambda i: F.concat(F.lit("DOC_"), F.pmod(F.col("id") + i, F.lit(50))))
    return synthesis.template_answers(s.withColumn("allowed", F.when(F.col("intent") == "full_audit", F.concat(docs, F.array(F.lit(T.TOOL_DOC)))).otherwise(docs)))


@query()
def contrastive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chosen and a spoiled answer for every customer, with the validators' reason."""
    return synthesis.contrastive_pairs(pair_rows(spark, sf_dir)).select("id", "intent", "dimension", "chosen", "rejected", "reason")


@query(f"""{_PAY}, t AS (SELECT id, ({str(['verify_epf', 'verify_esi', 'full_audit'])})[{_draw('id', 'intent', 3)} + 1] AS intent FROM s) SELECT intent, count(*) AS n FROM t GROUP BY GROUPING SETS ((intent), ())""")
def pair_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted, not filtered: a filter would go below every step of the slots and put their whole expressions in place of each name.
    p = pair_rows(spark, sf_dir).select("intent", F.col("chosen").isNotNull().alias("made"))
    n = p.groupingSets([["intent"], []], "intent").agg(F.count_if("made").alias("n"), F.grouping_id().alias("whole"))
    return n.where("n > 0 OR whole > 0").select("intent", "n")


def _ranged(name: str) -> str:
    one = " ".join(f"WHEN intent = '{i}' THEN {_choice('id', name, tuple(map(Q.text, v[name])) if isinstance(v[name][0], str) else v[name])}" for i, v in A.RANGES.items() if name in v)
    return f"CASE {one} END AS {name}"


_DRAWN = [n for n in (*synthesis.AMOUNTS, *synthesis.NAMES) if any(n in v for v in A.RANGES.values())]
_INTENTS = f"""WITH i AS (SELECT c_custkey AS id, {_choice('c_custkey', 'intent', tuple(map(Q.text, A.RANGES)))} AS intent FROM customer), v0 AS (SELECT id, intent, {', '.join(map(_ranged, _DRAWN))} FROM i),
v1 AS (SELECT *, {_draw('id', 'right', 100)} < 60 AS ok, round_even(basic_salary * 0.12::DOUBLE, 0)::BIGINT AS due, round_even(gross_salary * 0.0075::DOUBLE, 0)::BIGINT AS due_esi FROM v0),
v AS (SELECT *, CASE WHEN intent = 'verify_epf' THEN CASE WHEN ok THEN due ELSE due + {_choice('id', 'off', (-450, -200, 350))} END END AS epf_deducted,
 CASE WHEN intent = 'verify_esi' THEN CASE WHEN gross_salary > 21000 THEN CASE WHEN ok THEN 0 ELSE 150 END WHEN ok THEN due_esi ELSE due_esi + {_choice('id', 'off', (-40, 25, 60))} END END AS esi_deducted FROM v1),
a AS (SELECT *, CASE intent WHEN 'tds_query' THEN CASE WHEN service_years >= 5 OR pf_withdrawal_amount <= 50000 THEN 0 ELSE round_even(pf_withdrawal_amount * 0.1::DOUBLE, 0)::BIGINT END WHEN 'verify_epf' THEN due WHEN 'verify_esi' THEN CASE WHEN gross_salary <= 21000 THEN due_esi ELSE 0 END
 WHEN 'gratuity' THEN CASE WHEN employment_years >= 5 THEN trunc(last_drawn_salary * 15 * employment_years / 26)::BIGINT ELSE 0 END WHEN 'hra_exemption' THEN rent_paid - round_even((annual_income // 12) * 0.1::DOUBLE, 0)::BIGINT
 WHEN 'deductions_80c' THEN CASE WHEN tax_regime = 'new_regime' THEN 0 ELSE least(section_80c_investments, 150000) END END AS amount,
 CASE WHEN intent = 'hra_exemption' THEN round_even((annual_income // 12) * CASE WHEN city_type = 'metro' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END, 0)::BIGINT END AS share FROM v),
w AS (SELECT *, CASE intent WHEN 'full_withdrawal' THEN CASE WHEN months_unemployed < 2 THEN 'early' WHEN service_years >= 5 THEN 'untaxed' ELSE 'taxed' END WHEN 'tds_query' THEN CASE WHEN service_years >= 5 THEN 'long' WHEN pf_withdrawal_amount <= 50000 THEN 'small' ELSE 'due' END
 WHEN 'transfer' THEN CASE WHEN uan_status = 'active' AND kyc_status = 'complete' THEN 'ready' ELSE 'blocked' END WHEN 'verify_epf' THEN CASE WHEN ok THEN 'right' ELSE 'wrong' END
 WHEN 'verify_esi' THEN CASE WHEN gross_salary > 21000 THEN CASE WHEN ok THEN 'exempt' ELSE 'undue' END WHEN ok THEN 'right' ELSE 'wrong' END WHEN 'gratuity' THEN CASE WHEN employment_years < 5 THEN 'short' ELSE 'due' END
 WHEN 'deductions_80c' THEN CASE WHEN tax_regime = 'new_regime' THEN 'none' ELSE 'claim' END ELSE 'only' END AS verdict FROM a),
t AS (SELECT *, CASE {' '.join(f"WHEN intent = '{i}' AND verdict = '{v}' THEN {Q.text(text + A.THEN)}" for (i, v), text in A.SAYS.items())} END AS form FROM w)"""
_FILLED = "form"
for _n in (*synthesis.AMOUNTS, "amount", "share"):
    _FILLED = f"replace({_FILLED}, '{{{_n}}}', coalesce(format('{{:,}}', {_n}::BIGINT), ''))"
for _n in synthesis.NAMES:
    _FILLED = f"replace({_FILLED}, '{{{_n}}}', coalesce(replace({_n}, '_', ' '), ''))"
_FILLED = f"replace({_FILLED}, '{{cite}}', 'DOC_' || (id % 50))"


@query(f"{_INTENTS} SELECT id, intent, verdict, amount::BIGINT AS amount, share::BIGINT AS share, {_FILLED} AS chosen FROM t")
def intent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer of one of thirteen intents for every customer, out of slots of four domains."""
    rows = synthesis.intent_slots(spread(customer_ids(spark, sf_dir), "id"), "id").withColumn("allowed", F.array(F.concat(F.lit("DOC_"), F.col("id") % 50)))
    return synthesis.intent_answers(rows).select("id", "intent", "verdict", "amount", "share", "chosen")


_SENT = "CASE domain " + " ".join(f"WHEN '{d}' THEN {Q.text(o)}" for d, o in A.OFFICES.items()) + " END"


@query(f"""WITH q AS (SELECT conv_id * 1000 + turn AS id, lower(coalesce(text, '')) AS q, coalesce(text, '') AS text, 'DOC_' || (length(coalesce(text, '')) % 50) AS cite FROM conversations WHERE role = 'user'),
k AS (SELECT *, {_draw('id', 'kind', 10)} < {synthesis.REFUSALS_OF_TEN} AS scope, {Q.ladder('q', T.OUT_OF_SCOPE, chr(39) + 'other' + chr(39))} AS category, {Q.route('q')} AS domain FROM q)
SELECT id, CASE WHEN scope THEN 'out_of_scope' ELSE 'not_covered' END AS kind, CASE WHEN scope THEN category END AS category, CASE WHEN NOT scope THEN md5(replace(replace({Q.text(A.UNCOVERED)}, '{{office}}', {_SENT}), '{{cite}}', cite)) END AS chosen, md5(replace({Q.text(A.MADE_UP)}, '{{cite}}', cite)) AS rejected, 'ok' AS reason FROM k""")
def refusal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's message refused, as out of scope or for lack of knowledge, beside an answer without ground."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("text", F.coalesce("text", F.lit("")))
    rows = q.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), S.route(F.col("text")).alias("domain"), F.array(F.concat(F.lit("DOC_"), F.length("text") % 50)).alias("allowed"))
    made = synthesis.refusal_pairs(rows)
    return made.select("id", "kind", "category", F.when(F.col("kind") == "not_covered", F.md5("chosen")).alias("chosen"), F.md5("rejected").alias("rejected"), "reason")


@query(f"""SELECT conv_id, turn, {Q.ladder("lower(coalesce(text, '') || CASE (conv_id + turn) % 5 WHEN 0 THEN ' can I sue?' WHEN 1 THEN ' crypto tips' WHEN 2 THEN ' a visa' ELSE '' END)", T.OUT_OF_SCOPE, chr(39) + 'other' + chr(39))} AS category FROM conversations""")
def out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of refusal of every message, with a question put behind it."""
    q = F.concat(F.coalesce("text", F.lit("")), F.expr("CASE (conv_id + turn) % 5 WHEN 0 THEN ' can I sue?' WHEN 1 THEN ' crypto tips' WHEN 2 THEN ' a visa' ELSE '' END"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", synthesis.refusal(q)["category"].alias("category"))


@query(f"""{corpus._bm25_sql(corpus.SEARCH_SQL, True, 5)} SELECT query_id, '**Result:** according to the sources ' || string_agg('[DOC_' || doc_id || ']', ' ' ORDER BY rank) || '.' AS answer FROM hits GROUP BY query_id""")
def vanilla_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain baseline: five passages, a prompt, an answer of the default endpoint."""
    d = corpus.documents(spark, sf_dir)
    hits = retrieve.bm25(d, corpus.asked(spark, sf_dir), 5).join(d, "doc_id")
    hit = F.struct("rank", F.concat(F.lit("DOC_"), F.col("doc_id")).alias("doc_id"), "effective_date", "domain", F.coalesce("text", F.lit("")).alias("content"))
    p = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return p.select("query_id", endpoints.column(endpoints.echo_generator, X.prompt_block(F.col("hits"))).alias("answer"))
