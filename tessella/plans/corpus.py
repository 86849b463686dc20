"""Queries on documents, passages, retrieval and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import tables as T
from tessella.functions import text as X
from tessella.operators import knowledge, retrieve
from tessella.plans import sql as Q
from tessella.plans.base import query, table
from tessella.sources import html

DOMAIN = "CASE doc_id % 4 WHEN 0 THEN 'pf' WHEN 1 THEN 'payslip' WHEN 2 THEN 'labour' ELSE 'tax' END"
DATE = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE concat('20', cast(10 + doc_id % 15 AS string), '-0', cast(1 + doc_id % 9 AS string), '-01') END"
SUBDOMAIN = "CASE doc_id % 3 WHEN 0 THEN 'withdrawal' WHEN 1 THEN 'transfer' ELSE 'gratuity' END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the knowledge base's columns made up from the id."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "source", "lang", f"{DOMAIN} AS domain", f"{DATE} AS effective_date", f"{SUBDOMAIN} AS subdomain")


def _bm25_sql(tokens: str, positive: bool, k: int, docs: str = "documents", asked: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""WITH d AS (SELECT doc_id, {tokens} AS t FROM {docs}), l AS (SELECT doc_id, t, len(t) AS dl FROM d), st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM l),
p AS (SELECT doc_id, dl, unnest(t) AS token FROM l), tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
i0 AS (SELECT token, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, st), m AS (SELECT avg(idf) AS mean_idf FROM i0), idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean_idf ELSE idf END AS idf FROM i0, m),
q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({tokens}) AS token FROM ({asked})) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 6) AS score FROM q JOIN idf USING (token) JOIN tf USING (token), st GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), hits AS (SELECT query_id, doc_id, rank, score FROM r WHERE rank <= {k}{' AND score > 0' if positive else ''})"""


SEARCH_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1)"
PLAIN_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"{_bm25_sql(SEARCH_SQL, True, 4)} SELECT * FROM hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best documents of every benchmark item."""
    return retrieve.bm25(documents(spark, sf_dir), asked(spark, sf_dir), 4)


@query(f"{_bm25_sql(PLAIN_SQL, False, 5)} SELECT * FROM hits")
def bm25_eval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.bm25(documents(spark, sf_dir), asked(spark, sf_dir), 5, X.plain_tokens, positive_only=False)


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest vectors of every vector whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings")
    return retrieve.knn(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


def _knn_sql(k: int) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i]::DOUBLE - embedding[i]::DOUBLE) * (a[i]::DOUBLE - embedding[i]::DOUBLE))), 6) AS score FROM q, embeddings),
hits AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, score FROM s) WHERE rank <= {k})"""


@query(f"{_knn_sql(4)} SELECT * FROM hits")
def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, 4)


@query(f"""{_knn_sql(5)}, g AS (SELECT a.query_id, l.label, list(h.vec_id ORDER BY h.rank) AS retrieved FROM q a JOIN embeddings l ON l.vec_id = a.query_id JOIN hits h ON h.query_id = a.query_id GROUP BY ALL),
one AS (SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = g.label AND list_contains(retrieved, e.vec_id)) / (SELECT count(*) FROM embeddings e WHERE e.label = g.label) AS recall,
 coalesce(1.0 / (SELECT min(list_position(retrieved, e.vec_id)) FROM embeddings e WHERE e.label = g.label AND list_contains(retrieved, e.vec_id)), 0) AS rr FROM g)
SELECT label, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM one GROUP BY GROUPING SETS ((label), ())""")
def retriever_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank where all vectors of the query's label are wanted. Only sizes of labels are joined, not their members."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = neighbours(spark, sf_dir, 5).join(v.withColumnRenamed("label", "found"), "vec_id").join(v.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    right = F.col("found") == F.col("label")
    one = hits.groupBy("query_id", "label").agg(F.count_if(right).alias("hits"), F.min(F.when(right, F.col("rank"))).alias("first"))
    one = one.join(v.groupBy("label").agg(F.count(F.lit(1)).alias("gold")), "label").select("label", (F.col("hits") / F.col("gold")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))
    return one.groupingSets([["label"], []], "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"))


SUPERSEDES = "CASE WHEN doc_id % 3 = 0 THEN cast(doc_id - 1 AS string) WHEN doc_id % 3 = 1 THEN '' END"
#: Passages by topics of 40 documents, ranked by id.
_TOPIC = f"SELECT doc_id // 40 AS query_id, doc_id, doc_id % 40 + 1 AS rank, {DOMAIN} AS domain, {DATE} AS effective_date, {SUBDOMAIN} AS subdomain, {SUPERSEDES} AS supersedes FROM documents"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.selectExpr("doc_id div 40 AS query_id", "doc_id", "doc_id % 40 + 1 AS rank", "domain", "effective_date", "subdomain", f"{SUPERSEDES} AS supersedes")


@query(f"""WITH h AS ({_TOPIC}), k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.query_id = h.query_id AND nullif(g.supersedes, '') = h.doc_id::VARCHAR))
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(nullif(effective_date, ''), '1900-01-01') DESC, rank) AS place FROM k""")
def rerank_by_date_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.by_date(retrieve.not_superseded(topics(spark, sf_dir))).select("query_id", "doc_id", "place")


@query(f"WITH h AS ({_TOPIC}) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (domain = CASE query_id % 4 WHEN 0 THEN 'pf' WHEN 1 THEN 'payslip' WHEN 2 THEN 'labour' ELSE 'tax' END)::INT DESC, rank) AS place FROM h")
def domain_priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topics(spark, sf_dir)
    return retrieve.own_domain_first(t, F.expr(DOMAIN.replace("doc_id", "query_id"))).select("query_id", "doc_id", "place")


_WANTED = "CASE query_id % 5 WHEN 0 THEN 'full_withdrawal' WHEN 1 THEN 'gratuity' WHEN 2 THEN 'refund_status' WHEN 3 THEN 'unheard_of' ELSE 'transfer' END"
_PAIRS = "(VALUES " + ", ".join(f"('{i}', '{s}')" for i, ss in T.INTENT_SUBDOMAINS.items() for s in ss) + ") AS w(intent, subdomain)"


@query(f"""WITH h AS (SELECT *, {_WANTED} AS intent FROM ({_TOPIC})), m AS (SELECT h.*, EXISTS (SELECT 1 FROM {_PAIRS} WHERE w.intent = h.intent AND w.subdomain = h.subdomain) AS hit FROM h),
s AS (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS met FROM m) SELECT query_id, doc_id, intent FROM s WHERE hit OR NOT met""")
def domain_passage_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topics(spark, sf_dir).withColumn("intent", F.expr(_WANTED))
    match = F.lit(False)
    for i, ss in T.INTENT_SUBDOMAINS.items():
        match = match | ((F.col("intent") == i) & F.col("subdomain").isin(*ss))
    return retrieve.matching_or_all(t, match).select("query_id", "doc_id", "intent")


_RELATED = " OR ".join(f"(ask = '{d}' AND domain IN ({', '.join(map(Q.text, ds))}))" for d, ds in T.RELATED_DOMAINS.items())


@query(f"SELECT query_id, doc_id FROM (SELECT *, CASE query_id % 5 WHEN 0 THEN 'pf' WHEN 1 THEN 'payslip' WHEN 2 THEN 'labour' WHEN 3 THEN 'tax' ELSE 'general' END AS ask FROM ({_TOPIC})) WHERE ask = 'general' OR {_RELATED}")
def related_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = F.expr("CASE query_id % 5 WHEN 0 THEN 'pf' WHEN 1 THEN 'payslip' WHEN 2 THEN 'labour' WHEN 3 THEN 'tax' ELSE 'general' END")
    ok = (ask == "general") | (F.col("domain") == "general")
    for d, ds in T.RELATED_DOMAINS.items():
        ok = ok | ((ask == d) & F.col("domain").isin(*ds))
    return topics(spark, sf_dir).where(ok).select("query_id", "doc_id")


_KEY = "md5(coalesce(text, ''))"


@query(f"SELECT doc_id, k FROM (SELECT doc_id, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id % 4, doc_id) AS n FROM documents) WHERE n = 1")
def kb_merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as four files, merged; the first file's first row of a text stays."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("k"), F.col("doc_id").alias("_line"))
    return knowledge.merge([d.where(F.col("doc_id") % 4 == n) for n in range(4)], "k").select("doc_id", "k")


@query(f"SELECT max(doc_id) AS doc_id, {_KEY} AS k FROM documents GROUP BY {_KEY}")
def kb_load_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("k"))
    return knowledge.one_per_key(d, "k", ["doc_id"], last=True)


@query("""WITH p AS (SELECT doc_id AS ord, CASE WHEN doc_id % 2 = 0 THEN concat('D', doc_id // 4) END AS id, concat('S', doc_id // 3) AS sec, md5(coalesce(text, '')) AS content FROM documents),
a AS (SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN concat('D', event_id // 7) WHEN 1 THEN concat('S', event_id // 5) ELSE concat('X', event_id) END AS identifier FROM events),
d AS (SELECT id AS k, id, arg_min(content, ord) AS content FROM p WHERE id IS NOT NULL GROUP BY id), s AS (SELECT sec AS k, arg_min(struct_pack(id := id), ord).id AS id, arg_min(content, ord) AS content FROM p GROUP BY sec)
SELECT n, identifier, coalesce(d.id, s.id) AS doc_id, coalesce(d.content, s.content) AS content FROM a LEFT JOIN d ON d.k = identifier LEFT JOIN s ON s.k = identifier""")
def policy_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_ord"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("D"), F.floor(F.col("doc_id") / 4))).alias("doc_id"), F.concat(F.lit("S"), F.floor(F.col("doc_id") / 3)).alias("section_id"), F.md5(F.coalesce("text", F.lit(""))).alias("content"))
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.expr("CASE event_id % 3 WHEN 0 THEN concat('D', event_id div 7) WHEN 1 THEN concat('S', event_id div 5) ELSE concat('X', event_id) END").alias("identifier"))
    return knowledge.look_up(a, p)


@query(f"SELECT domain, subdomain, count(*) AS n FROM (SELECT {DOMAIN} AS domain, {SUBDOMAIN} AS subdomain FROM documents WHERE length(text) > 10) GROUP BY GROUPING SETS ((domain), (domain, subdomain), ())")
def kb_filter_and_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).where(F.length("text") > 10)
    return d.groupingSets([["domain"], ["domain", "subdomain"], []], "domain", "subdomain").agg(F.count(F.lit(1)).alias("n"))


#: A text with form numbers, page marks and terms put into the document's own, by its id.
MARKED = "concat('Page ', cast(doc_id % 90 AS string), chr(10), chr(10), coalesce(text, ''), '  Form 19A and Form', cast(doc_id % 40 AS string), 'C ', CASE doc_id % 6 WHEN 0 THEN 'Withdrawal above 50000' WHEN 1 THEN 'KYC is complete' WHEN 2 THEN 'pension' WHEN 3 THEN 'TDS if less than 5 years' ELSE '' END)"


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED).alias("t"))


CLEAN_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(t, '\n+', chr(10), 'g'), '\s+', ' ', 'g'), 'Page \d+', '', 'g'))"
_M = f"WITH x AS (SELECT doc_id, {MARKED} AS t FROM documents)"


@query(f"{_M} SELECT doc_id, md5({CLEAN_SQL}) AS digest, length({CLEAN_SQL}) AS n_chars FROM x")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.clean(F.col("t"))
    return marked(spark, sf_dir).select("doc_id", F.md5(c).alias("digest"), F.length(c).alias("n_chars"))


@query(f"{_M} SELECT doc_id, array_to_string(regexp_extract_all(t, 'Form\\s?\\d+[A-Z]*'), '|') AS forms FROM x")
def extract_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", F.array_join(X.forms(F.col("t")), "|").alias("forms"))


@query(f"{_M} SELECT doc_id, {Q.ladder('lower(t)', (('withdrawal', ('withdrawal',)), ('kyc', ('kyc',)), ('pension', ('pension',)), ('tax', ('tds',))), chr(39) + 'general' + chr(39))} AS domain FROM x")
def infer_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", X.topic(F.col("t")).alias("domain"))


@query(f"""{_M}, l AS (SELECT doc_id, lower(t) AS t FROM x) SELECT doc_id, 'service_years' AS field, 'lt' AS operator, '5' AS value, 'TDS_APPLICABLE' AS outcome, 'WARNING' AS kind FROM l WHERE contains(t, 'less than 5 years')
UNION ALL SELECT doc_id, 'withdrawal_amount', 'gt', '50000', 'TDS_APPLICABLE', 'WARNING' FROM l WHERE contains(t, 'more than 50000') OR contains(t, 'above 50000')
UNION ALL SELECT doc_id, 'kyc_status', 'eq', 'complete', 'ELIGIBLE', 'MANDATORY' FROM l WHERE contains(t, 'kyc') AND contains(t, 'complete')""")
def rule_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).select("doc_id", F.explode(X.rule_conditions(F.col("t"))).alias("c")).select("doc_id", "c.*")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document; a sequential fold, so tested against a plain loop."""
    return knowledge.chunks(table(spark, sf_dir, "documents"), X.clean(F.coalesce("text", F.lit(""))))


@query(r"SELECT doc_id, md5(array_to_string(list_slice(list_filter(regexp_split_to_array(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE source || ': ' || coalesce(text, '') END, '\s+'), lambda x: x <> ''), 1, 500), ' ')) AS digest FROM documents")
def encode_text_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    title = F.when(F.col("doc_id") % 3 != 0, F.col("source"))
    return d.select("doc_id", F.md5(X.encoder_text(title, F.coalesce("text", F.lit("")))).alias("digest"))


@query()
def html_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query()
def html_table_faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer rows of tables; the pages' menus are made into tables first, as they have none of their own."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", "<li>(.*?)</li>", "<tr><td>$1</td><td>about $1</td></tr>"), "(</?)ul>", "$1table>").alias("html"))
    return html.extract(p, lists=False)


_BLOCK = f"'[Source ' || rank || '] doc_id=' || doc_id || ' | date=' || coalesce({DATE}, 'None') || ' | domain=' || {DOMAIN} || chr(10) || substr(coalesce(text, ''), 1, 1500)"


@query(f"""{_bm25_sql(SEARCH_SQL, True, 4)} SELECT query_id, md5(string_agg({_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest, count(*) AS n FROM hits JOIN documents USING (doc_id) GROUP BY query_id""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt's passages of every benchmark item; texts are joined after the cut to four."""
    return passages(spark, sf_dir).select("query_id", F.md5(X.prompt_block(F.col("hits"))).alias("digest"), F.size("hits").cast("long").alias("n"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    hits = retrieve.bm25(d, asked(spark, sf_dir), 4).join(d, "doc_id")
    hit = F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"), "effective_date", "domain", F.coalesce("text", F.lit("")).alias("content"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))


@query(f"""{_bm25_sql(SEARCH_SQL, True, 4)}, b AS (SELECT query_id, string_agg({_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS block FROM hits JOIN documents USING (doc_id) GROUP BY query_id)
SELECT query_id, md5('USER QUERY:' || chr(10) || text || chr(10) || chr(10) || 'DOMAIN: pf' || chr(10) || chr(10) || 'RETRIEVED PASSAGES:' || chr(10) || block || chr(10) || chr(10) || 'SLOTS FILLED:' || chr(10) || '{{"intent":"general","service_years":"' || (query_id % 9) || '"}}' || chr(10) || chr(10) || 'Produce the final answer now.') AS digest
FROM b JOIN benchmark ON item_id = query_id""")
def generator_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages(spark, sf_dir).join(asked(spark, sf_dir), "query_id")
    slots = F.map_filter(F.create_map(F.lit("intent"), F.lit("general"), F.lit("service_years"), (F.col("query_id") % 9).cast("string"), F.lit("state"), F.lit(None).cast("string")), lambda _, v: v.isNotNull())
    return p.select("query_id", F.md5(generator_text(F.col("text"), F.lit("pf"), X.prompt_block(F.col("hits")), None, F.to_json(slots))).alias("digest"))


def generator_text(q, domain, block, trace, slots):
    """What a generator reads: question, domain, passages, trace if there is one, and slots."""
    parts = [F.concat(F.lit("USER QUERY:\n"), q), F.concat(F.lit("DOMAIN: "), domain), F.concat(F.lit("RETRIEVED PASSAGES:\n"), block)]
    return F.concat_ws("\n\n", *parts, *([trace] if trace is not None else []), F.concat(F.lit("SLOTS FILLED:\n"), slots), F.lit("Produce the final answer now."))


@query("SELECT r AS doc_id, count(*) AS n FROM (SELECT doc_id + CASE WHEN doc_id % 5 = 0 THEN 1000000000 ELSE 0 END AS r FROM labels) WHERE r NOT IN (SELECT doc_id FROM documents) GROUP BY r")
def referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References out of labels, a fifth of them to ids that don't exist."""
    away = F.col("doc_id") + F.when(F.col("doc_id") % 5 == 0, 1_000_000_000).otherwise(0)
    return knowledge.unknown_ids(table(spark, sf_dir, "labels").select(F.array(away).alias("passage_doc_ids")), table(spark, sf_dir, "documents"))


_ROUNDS = "SELECT item_id * 3 + r AS query_id, CASE r WHEN 0 THEN text WHEN 1 THEN left(text, 60) ELSE right(text, 60) END AS text FROM benchmark, (VALUES (0), (1), (2)) AS v(r)"


@query(f"""{_bm25_sql(SEARCH_SQL, True, 4, asked=_ROUNDS)}, a AS (SELECT query_id // 3 AS query_id, query_id % 3 AS round, rank, doc_id FROM hits), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round, rank) AS n FROM a)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round, rank) AS place FROM f WHERE n = 1""")
def react_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches for every item, the whole and both ends; each document counts once."""
    q = asked(spark, sf_dir)
    three = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), t.alias("t")) for r, t in enumerate((F.col("text"), F.left("text", F.lit(60)), F.right("text", F.lit(60))))]))
    q = q.select("query_id", three.alias("x")).select((F.col("query_id") * 3 + F.col("x.r")).alias("query_id"), F.col("x.t").alias("text"))
    hits = retrieve.bm25(documents(spark, sf_dir), q, 4)
    return retrieve.accumulate(hits.select(F.expr("query_id div 3").alias("query_id"), (F.col("query_id") % 3).alias("round"), "rank", "doc_id")).select("query_id", "doc_id", "place")
