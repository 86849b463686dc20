"""The queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat_format, collocations, decontaminate, histogram_shards, html_extract, language_id, lattice_dedup, packing, quality_rules, secret_scan, simhash, structure_repair, warc
from tessella.llm.common import table

END_ID = 2


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


def op4_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = histogram_shards.assign(table(spark, sf_dir, "documents"), shards=24)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return sharded.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.annotate(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *quality_rules.METRICS, "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    profiles = language_id.train(docs.where(~F.coalesce("held_out", F.lit(True))))
    return language_id.predict(docs, profiles, keep=("doc_id", "held_out"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    return chat_format.digest(chat_format.format_chats(rows.unionByName(fixed)))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return structure_repair.digest(structure_repair.damage(rows), rows)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(collocations.mine(table(spark, sf_dir, "documents")))


def op13_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    ops = (op1_secret_scan, op2_html_extract, op3_warc, op4_histogram_shards, op5_quality_rules, op6_language_id, op7_chat_format, op8_packing, op9_decontaminate, op10_simhash, op11_structure_repair, op12_collocations, op13_lattice_dedup)
    return {f.__name__: f for f in ops}


_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

_OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
s AS (SELECT count(*) AS h, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ffn, sum(f) / sum(n) AS mean FROM hosts),
r AS (SELECT *, (ffn - mean * f - (h - 1) * mean * (1 - mean)) / nullif((n - nn / n - (h - 1)) * mean * (1 - mean), 0) AS rho FROM s),
prior AS (SELECT mean, CASE WHEN rho > 0 THEN least(1e6, 1 / rho - 1) ELSE 1e6 END AS k FROM r),
bad AS (SELECT source FROM hosts, prior WHERE (f + mean * k) / (hosts.n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM b.source) AS kept
FROM b
"""

_CONTROLS = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) / {len(c)}" for c in ("\\", *chat_format.CONTROLS))
_OP7 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT conv_id, turn, sum(length(x) + {_CONTROLS}) AS n FROM (SELECT conv_id, turn, unnest([role, text]) AS x FROM t) GROUP BY conv_id, turn)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.START + chat_format.HEAD + chat_format.END)} + n)::BIGINT AS formatted_chars
FROM t JOIN e USING (conv_id, turn) GROUP BY conv_id
"""


_OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM d),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS s(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
longer AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, ((1000000::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a
QUALIFY rank <= 2000
"""


_OP13 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT k, CASE WHEN len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 THEN e END AS e FROM v),
l AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM ok WHERE e IS NOT NULL),
link AS (SELECT a.k, b.k AS o FROM l a JOIN l b ON a.k <> b.k AND len(a.e) = len(b.e) AND list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.norm * b.norm) >= 0.95),
reach(k, o) AS (SELECT k, k FROM v UNION SELECT r.k, l.o FROM reach r JOIN link l ON r.o = l.k),
c AS (SELECT r.k, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.k = r.o GROUP BY r.k),
n AS (SELECT k, count(*) AS n FROM link GROUP BY k)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (k) LEFT JOIN n USING (k)
"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the others are tested against brute force."""
    return {"op3_warc": _OP3, "op5_quality_rules": _OP5, "op7_chat_format": _OP7, "op12_collocations": _OP12, "op13_lattice_dedup": _OP13}
