"""Knowledge-base rows: merging, lookups, chunks, and references between tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import tables as T


def one_per_key(rows: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the order of columns that number rows uniquely. Keys are pre-aggregated to the winner's
    number, so copies of one key meet only as partial minima; rows with a null key are a key of their own."""
    place = F.struct(*order)
    win = rows.groupBy(key).agg((F.max if last else F.min)(place).alias("_w")).select("_w")
    return rows.withColumn("_w", place).join(win, "_w", "left_semi").drop("_w")


def merge(files: list[DataFrame], key: str) -> DataFrame:
    """Files in order (each with _line) as one; the first row of a key stays."""
    out = None
    for n, f in enumerate(files):
        f = f.withColumn("_file", F.lit(n))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return one_per_key(out, key, ["_file", "_line"])


def look_up(asked: DataFrame, policies: DataFrame) -> DataFrame:
    """asked (identifier) with the policy of that doc_id, or else of that section_id; the first row of an id counts (_ord)."""
    by_doc = one_per_key(policies.where("doc_id is not null"), "doc_id", ["_ord"]).select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("_doc"), F.col("content").alias("_doc_content"))
    by_section = one_per_key(policies.where("section_id is not null"), "section_id", ["_ord"]).select(F.col("section_id").alias("_id"), F.col("doc_id").alias("_sec"), F.col("content").alias("_sec_content"))
    found = asked.join(by_doc, asked["identifier"] == by_doc["_id"], "left").drop("_id").join(by_section, asked["identifier"] == by_section["_id"], "left").drop("_id")
    content = F.when(F.col("_doc").isNotNull(), F.col("_doc_content")).otherwise(F.col("_sec_content"))
    return found.select(*asked.columns, F.coalesce("_doc", "_sec").alias("doc_id"), content.alias("content"))


def resolve(prompts: DataFrame, policies: DataFrame, placeholder: bool = False) -> DataFrame:
    """(id, passages): the contents of prompts' passage ids in order. Unknown ids fall out, or read `[passage unavailable]`."""
    one = prompts.select("id", F.posexplode("passage_doc_ids").alias("pos", "doc_id"))
    met = one.join(policies.select("doc_id", "content"), "doc_id", "left" if placeholder else "inner")
    passage = F.struct("pos", "doc_id", F.coalesce("content", F.lit("[passage unavailable]")).alias("content"))
    return met.groupBy("id").agg(F.array_sort(F.collect_list(passage)).alias("passages"))


def unknown_ids(prompts: DataFrame, policies: DataFrame) -> DataFrame:
    """Referenced ids that no policy has, with the number of references."""
    return prompts.select(F.explode("passage_doc_ids").alias("doc_id")).join(policies.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def chunk(text: str, limit: int = T.CHUNK_WORDS, overlap: int = T.CHUNK_OVERLAP) -> list[tuple[str, int]]:
    """(chunk, start) of a cleaned text: sentences are added until the next would pass the limit; then the chunk ends, and the next begins with its last words.
    A sentence over the limit isn't cut, and if it comes first an empty chunk precedes it. Starts leave the overlap out of account."""
    out, now, start = [], [], 0
    for sentence in re.split(r"(?<=[.!?]) +", text):
        words = sentence.split()
        if len(now) + len(words) > limit:
            done = " ".join(now)
            out.append((done, start))
            start += len(done)
            now = now[-overlap:] + words
        else:
            now = now + words
    if now:
        out.append((" ".join(now), start))
    return out


def chunks(docs: DataFrame, text: Column, limit: int = T.CHUNK_WORDS, overlap: int = T.CHUNK_OVERLAP, key: str = "long") -> DataFrame:
    """(doc_id: of type key, chunk_index, total_chunks, content, span_start, span_end) of every document. A text is folded in one pass, in time linear in its length."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), strict=True):
                parts = chunk(t or "", limit, overlap)
                out += [(i, k, len(parts), s, a, a + len(s)) for k, (s, a) in enumerate(parts)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.string() if key == "string" else pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "chunk_index", "total_chunks", "content", "span_start", "span_end"])

    return docs.select("doc_id", text.alias("t")).mapInArrow(of, f"doc_id {key}, chunk_index int, total_chunks int, content string, span_start long, span_end long")


def chunk_rows(chunked: DataFrame, domain: str, year: int) -> DataFrame:
    """Chunks as knowledge-base rows with made-up ids `{domain}_{year}_{doc_id}`, `_S{i}` and `_chunk_{i}`."""
    base = F.concat_ws("_", F.lit(domain), F.lit(year), F.col("doc_id"))
    return chunked.withColumns({"section_id": F.concat(base, F.lit("_S"), F.col("chunk_index")), "chunk_id": F.concat(base, F.lit("_chunk_"), F.col("chunk_index")), "doc_id": base})
