"""Queries on what is built before questions are answered: rows from pages, conditions from a model, index versions, and typed records."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import building, endpoints, synthesis
from tessella.plans import corpus, training
from tessella.plans.base import query, shared_dir, table


@query()
def pages_to_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files whose lines are pages, as knowledge-base rows."""
    lines = table(spark, sf_dir, "documents").select(F.concat(F.lit("kb/doc_"), F.col("doc_id"), F.lit(".pdf")).alias("path"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "text"))
    return building.kb_rows(lines.select("path", (F.col("k") + 1).alias("page"), "text"), "2026-01-31")


def _model(prompts: list[str]) -> list[str]:
    """A stand-in for a model: one condition, no list, or two, by the length of what it is shown."""
    out = []
    for p in prompts:
        n = len(p.split("\n\n", 1)[1])
        one = {"field": "length", "operator": "gte", "value": n, "mandatory": True}
        out.append("```json\n" + json.dumps([one] if n % 3 == 0 else one if n % 3 == 1 else [one, {"operator": "eq"}, one | {"operator": "lt", "doc_id": "OTHER"}]) + "\n```")
    return out


@query("""WITH d AS (SELECT doc_id, least(length(coalesce(text, '')), 600) AS n FROM documents)
SELECT doc_id, CASE WHEN n < 20 OR n % 3 = 1 THEN 0 WHEN n % 3 = 0 THEN 1 ELSE 2 END AS conditions, CASE WHEN n >= 20 AND n % 3 <> 1 THEN 'length gte ' || n || ' [DOC_' || doc_id || ']' || CASE WHEN n % 3 = 2 THEN '; length lt ' || n || ' [OTHER]' ELSE '' END ELSE '' END AS said FROM d""")
def conditions_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model reads out of every document, each prompt sent once."""
    p = corpus.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.lit("DOC_"), "doc_id").alias("doc_id"), F.col("text").alias("content"), F.lit("pf").alias("asked"), F.lit("transfer").alias("intent"))
    made = building.model_conditions(p, _model)
    said = F.array_join(F.transform("conditions", lambda c: F.concat(c["field"], F.lit(" "), c["operator"], F.lit(" "), c["value"], F.lit(" ["), c["doc_id"], F.lit("]"))), "; ")
    return made.select(F.col("id").alias("doc_id"), F.size("conditions").alias("conditions"), said.alias("said"))


_TEXT = "array_to_string(list_filter(regexp_split_to_array(coalesce(source || ': ', '') || {}, '\\s+'), lambda w: w <> '')[1:500], ' ')"


@query(f"""WITH a AS (SELECT doc_id, {_TEXT.format("coalesce(text, '')")} AS t FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN {_TEXT.format("coalesce(text, '') || ' amended'")} ELSE {_TEXT.format("coalesce(text, '')")} END AS t FROM documents)
SELECT 1 AS version, count(*) AS vectors, count(DISTINCT t) AS encoded FROM a UNION ALL SELECT 2, count(*), count(DISTINCT t) FILTER (t NOT IN (SELECT t FROM a)) FROM b""")
def index_life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of an index: how many vectors each has, and how many of their texts the version before didn't have."""
    d, path = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    row = lambda text: (F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("title"), text.alias("content"))
    text = F.coalesce("text", F.lit(""))
    first = building.publish(d.where("doc_id % 3 <> 0").select(*row(text)), path, endpoints.hashed_encoder(), 1)
    second = building.publish(d.select(*row(F.when(F.col("doc_id") % 10 == 1, F.concat(text, F.lit(" amended"))).otherwise(text))), path, endpoints.hashed_encoder(), 2)
    new = second.join(first.select("digest").distinct(), "digest", "left_anti")
    count = lambda n, all_, fresh: all_.agg(F.count(F.lit(1)).alias("vectors")).crossJoin(fresh.agg(F.count_distinct("digest").alias("encoded"))).select(F.lit(n).alias("version"), "vectors", "encoded")
    return count(1, first, first).unionByName(count(2, second, new))


@query(f"""{training._PAY} SELECT id, basic_salary, CASE WHEN id % 7 <> 0 THEN epf_deducted::BIGINT END AS epf_deducted, gross_salary > 21000 AS above_limit, 'DOC_' || (id % 50) AS first_passage FROM s""")
def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pairs as lines of JSON, read back, with metadata read by path."""
    p = training.pair_rows(spark, sf_dir).withColumn("full_prompt", F.concat(F.lit("prompt "), F.col("id"))).withColumn("rejected", F.lit("no"))
    slots = {"basic_salary": F.col("basic_salary"), "epf_deducted": F.when(F.col("id") % 7 != 0, F.col("epf_deducted")), "above_limit": F.col("gross_salary") > 21000}
    made = synthesis.records(p, slots, id=F.col("id"), passage_ids=F.col("allowed"))
    back = made.select(synthesis.read_record(F.to_json(F.struct(*made.columns))).alias("r")).select("r.*")
    get = lambda path, kind: F.try_variant_get("metadata", path, kind)
    return back.select(get("$.id", "long").alias("id"), get("$.slots.basic_salary", "long").alias("basic_salary"), get("$.slots.epf_deducted", "long").alias("epf_deducted"), get("$.slots.above_limit", "boolean").alias("above_limit"), get("$.passage_ids[0]", "string").alias("first_passage"))
