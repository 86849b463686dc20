"""Building what questions are answered from: pages to knowledge-base rows, conditions that a model reads, and versions of the vector index."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import endpoints, knowledge
from tessella.operators.storage import cut
from tessella.sources import log

#: Stands between pages while a document is cleaned; no text has it.
MARK = "\ue000"


def _starts(marked: Column) -> Column:
    """Where each page begins in a clean text that is marked between its pages, in one pass over it."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [*accumulate(map(len, t.split(MARK)[:-1]), initial=0)])

    return F.pandas_udf(of, "array<long>")(marked)


def kb_rows(pages: DataFrame, date: str, limit: int = 384, overlap: int = 64) -> DataFrame:
    """Knowledge-base rows, a row a chunk, of pages (path, page: from 1, text) of documents.

    A document is its pages joined and cleaned; its domain is its topic, its id that, the year of `date` and the file's stem. `page_numbers` has all of its pages, `pages_hit` those that the
    chunk's span overlaps: pages are marked before cleaning, so their places in the clean text are known. Documents are held one at a time; documents without words give no rows.
    """
    p = pages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    whole = X.clean(F.array_join("p.text", " "))
    starts = _starts(X.clean(F.array_join("p.text", f" {MARK}")))
    docs = p.withColumns({"_text": whole, "_starts": starts, "title": stem}).withColumn("domain", X.topic(F.col("_text")))
    docs = docs.withColumn("doc_id", F.concat_ws("_", "domain", F.lit(date[:4]), "title"))
    docs = cut(docs.select(F.col("path").alias("source_file"), "doc_id", "title", "domain", F.col("p.page").alias("page_numbers"), "_text", "_starts", F.xxhash64("path").alias("_key")), "kb-pages")
    made = knowledge.chunks(docs.select(F.col("source_file").alias("doc_id"), "_text"), F.col("_text"), limit, overlap, "string").withColumnRenamed("doc_id", "source_file")
    rows = made.join(docs.drop("_text", "_key"), "source_file")
    last = F.greatest(F.col("span_start"), F.col("span_end") - 1)
    ends = F.transform("_starts", lambda s, k: F.coalesce(F.get("_starts", k + 1), F.lit(1 << 62)))
    touched = F.filter(F.arrays_zip("page_numbers", F.col("_starts").alias("s"), ends.alias("e")), lambda x: (x["s"] <= last) & (x["e"] > F.col("span_start")))
    conditions = X.rule_conditions(F.col("content"))
    return rows.select(
        "doc_id", "title", "content", F.col("source_file").alias("source_url"), F.lit(date).alias("effective_date"), F.lit(None).cast("string").alias("supersedes"), "domain", F.concat("doc_id", F.lit("_S"), "chunk_index").alias("section_id"), "span_start", "span_end",
        conditions.alias("conditions"), conditions["field"].alias("required_slots"), X.forms(F.col("content")).alias("forms"), F.concat("doc_id", F.lit("_chunk_"), "chunk_index").alias("chunk_id"), "chunk_index", "total_chunks", "source_file", "page_numbers", touched["page_numbers"].alias("pages_hit"))


#: Characters of a passage that a model reads for conditions; shorter passages than SHORTEST aren't sent.
READ, SHORTEST, MOST = 600, 20, 4
CONDITION = "array<struct<field:string,operator:string,value:string,mandatory:boolean,doc_id:string>>"


def parsed_reply(reply: Column, most: int = MOST) -> Column:
    """CONDITION out of a model's reply: the objects with a field of a JSON list, the first `most`; replies that are no list, or no JSON, have none."""
    bare = F.regexp_replace(X.unfenced(reply), r"^\s+|\s+$", "")
    v = F.try_parse_json(bare)
    items = F.when(bare.startswith("["), F.try_variant_get(v, "$", "array<variant>"))
    get = lambda x, name, kind: F.try_variant_get(x, f"$.{name}", kind).alias(name)
    made = F.transform(items, lambda x: F.struct(get(x, "field", "string"), get(x, "operator", "string"), get(x, "value", "string"), get(x, "mandatory", "boolean"), get(x, "doc_id", "string")))
    return F.coalesce(F.slice(F.filter(made, lambda c: c["field"].isNotNull()), 1, most), F.array().cast(CONDITION))


def model_conditions(passages: DataFrame, endpoint: endpoints.Endpoint, most: int = MOST, **call: int | float) -> DataFrame:
    """passages (query_id, doc_id, content, asked, intent, ...) with `conditions`, as a model reads them. Equal prompts, of whichever questions, are sent once, and replies joined back; a call that
    fails gives none. Conditions without an id have their passage's."""
    shown = F.left(F.coalesce("content", F.lit("")), F.lit(READ))
    prompt = F.when(F.length(shown) >= SHORTEST, F.concat(F.lit("Domain: "), F.coalesce("asked", F.lit("None")), F.lit("\nUser intent: "), F.coalesce("intent", F.lit("general")), F.lit("\ndoc_id: "), F.coalesce("doc_id", F.lit("UNKNOWN")), F.lit("\n\n"), shown))
    rows = passages.withColumn("_prompt", prompt)
    each = rows.where("_prompt IS NOT NULL").select("_prompt").distinct()
    replies = cut(each.select("_prompt", endpoints.column(endpoint, F.col("_prompt"), **call).alias("_reply")), "model-conditions").select(F.col("_prompt").alias("_sent"), "_reply")
    met = rows.join(replies, F.col("_prompt") == F.col("_sent"), "left")
    own = F.transform(parsed_reply(F.col("_reply"), most), lambda c: c.withField("doc_id", F.coalesce(c["doc_id"], "doc_id")))
    return met.withColumn("conditions", own).drop("_prompt", "_sent", "_reply")


VECTORS = "doc_id string, digest string, embedding array<double>"


def versions(spark: SparkSession, path: str) -> list[str]:
    """The folders of an index's published versions, oldest first. A build that was cut off isn't one."""
    return log.committed(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """VECTORS of the last published version."""
    return log.newest(spark, path, VECTORS)


def publish(kb: DataFrame, path: str, encode: endpoints.Encoder, version: int) -> DataFrame:
    """Publishes the vectors of kb (doc_id, title, content; distinct ids) as a version and returns them.

    Only texts that the last version before doesn't have are encoded, each once however many rows have it. A version is written to a folder of its own and counts from its mark of success on, so
    readers of earlier versions go on, and a build that was lost is made again under its number.
    """
    spark = kb.sparkSession
    said = X.encoder_text(F.col("title"), F.col("content"))
    rows = cut(kb.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(said, F.lit("")).alias("_text")).withColumn("digest", F.sha2("_text", 256)), "index-texts")
    known = log.newest(spark, path, VECTORS, before=version).select("digest", "embedding").dropDuplicates(["digest"])
    fresh = rows.join(known, "digest", "left_anti").groupBy("digest").agg(F.min("_text").alias("_text"))
    made = cut(fresh.select("digest", endpoints.vectors(encode, F.col("_text")).alias("embedding")), "index-vectors")
    rows.select("doc_id", "digest").join(known.unionByName(made), "digest").select("doc_id", "digest", "embedding").write.mode("overwrite").parquet(log.folder(path, version))
    return spark.read.schema(VECTORS).parquet(log.folder(path, version))
