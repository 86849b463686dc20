"""A corpus pipeline of five of the operators: quality rules, SimHash near-dedup, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents. Verdicts of near-dedup and decontamination are on rows, by a hash of id and text, so
a row of the same id and another text isn't touched. Near copies without an id stay.

Defined results of every stage: an empty table gives an empty table. A null text is an empty text: quality rules reject it (no words), and later
stages, if they are given one, keep it without a leak or a secret and pack its end token. Rows are judged one by one whether they repeat or not,
but for near-dedup. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, packing, quality_rules, queries, secret_scan, simhash
from tessella.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word and line rules or their host's verdict reject go; documents without a source share one host."""
    return quality_rules.annotate(docs).where("kept").select(*docs.columns)


#: Links of near-dedup: minwise bits of five-word shingles, of which those of one of eight rounds differ in three of 48 at most, and 64 further ones in thirteen. A pair with a similarity
#: of 0.8 is a link with a probability of 0.92 then, one of 0.85 with 0.99, one of 0.6 with 0.05, one of 0.5 with 0.002.
WORDS, RADIUS, ROUNDS, CHECK_RADIUS = 5, 3, 8, 13


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays (of several texts under that id, the one of the smallest hash); of equal
    rows, one. Texts without words, null included, are one group. Rows without an id are never removed as near copies. Keys alone are counted
    and compared; whole rows are compared only where a key repeats."""
    rows = keyed(docs)
    found = materialise(simhash.near_duplicates(rows, n_words=WORDS, radius=RADIUS, rounds=ROUNDS, check_radius=CHECK_RADIUS, minwise_bits=True, key="_key"), "near-verdicts")
    owners = found.where("component_id = doc_id").groupBy("doc_id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most")
    others = found.where("component_id = doc_id").join(owners, "doc_id").where("key <> least").select("key")
    gone = found.where("component_id != doc_id").select("key").unionByName(others).distinct().withColumnRenamed("key", "_key")
    again = found.groupBy(F.col("key").alias("_key")).count().where("count > 1").select("_key").join(gone, "_key", "left_anti")
    once = rows.join(gone.unionByName(again), "_key", "left_anti").select(*docs.columns)
    return once.unionByName(rows.join(again, "_key", "left_semi").select(*docs.columns).distinct())


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item, verbatim or with other slots, go; with or without an id, and all rows of an equal id and text."""
    rows = keyed(docs)
    leaks = decontaminate.leaks(rows, table(spark, sf_dir, "benchmark"), doc_id="_key").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(leaks, "_key", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; n_chars follows the text (null for a null text)."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens; only longer documents are cut."""
    return packing.pack(packing.pieces(docs, queries.tokenizer_path(), queries.END_ID))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("secret scans", secrets), ("best-fit packing", pack)]

#: XXH64 fingerprints, components, Markov models and tokenizers can't be said in DuckDB SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
