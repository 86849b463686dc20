"""Sources and sinks of files: JSON lines and arrays, PDF text, quarantined rows, statistics, reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.storage import cut
from tessella.sources import log

KB_SCHEMA = (
    "doc_id string, title string, content string, source_url string, effective_date string, supersedes string, domain string, subdomain string, section_id string, source_type string, "
    "span_start int, span_end int, conditions array<string>, required_slots array<string>, forms array<string>, chunk_id string, chunk_index int, total_chunks int, language string, "
    "query_type array<string>, verified_against string"
)


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON-lines files with _file and _line, which number rows in reading order; blank lines don't count as rows. Lines that can't be
    read are dropped (strict: they fail)."""
    text = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line")).where(F.trim("value") != "")
    parsed = text.withColumn("_row", F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    good = F.try_parse_json("value").isNotNull()
    return parsed.where(F.lit(True) if strict else good).select("_row.*", "_file", "_line")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_lines(df: DataFrame, path: str, ascii_only: bool = False) -> None:
    """JSON lines in UTF-8, or with all other characters than ASCII escaped."""
    line = F.to_json(F.struct(*df.columns))
    if ascii_only:
        line = F.array_join(F.transform(F.split(line, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(_escaped(c))), "")
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def _escaped(c: Column) -> Column:
    """The character as one or two escapes of UTF-16 units."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    return F.lower(F.regexp_replace(units, "(.{4})", r"\\u$1"))


def append_once(df: DataFrame, key: str, path: str, order: list[str] | None = None, batch: str | None = None) -> DataFrame:
    """Appends to a log (see sources.log) the first row of each key that it doesn't have yet, and returns those rows: a generator that is run again goes on where it
    stopped. Rows of a key are told apart by the order columns, by default all. A write that is repeated under its batch's name adds nothing."""
    return log.append(df, key, path, batch or uuid.uuid4().hex, order or df.columns)


def split_accepted(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their reason)."""
    judged = df.withColumn("reason", reason)
    return judged.where("reason = 'ok'").drop("reason"), judged.where("reason <> 'ok'")


def statistics(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by each key and of all rows, in one pass: (key, value, n)."""
    sets = [[k] for k in keys] + [[]]
    g = df.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(k).alias(f"_{k}") for k in keys])
    name, value = F.lit("all"), F.lit(None).cast("string")
    for k in keys:
        name, value = F.when(F.col(f"_{k}") == 0, k).otherwise(name), F.when(F.col(f"_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    return g.select(name.alias("key"), value.alias("value"), "n")


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table of the first rows, for people."""
    rows = df.limit(limit).collect()
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]])


def pdf_pages(spark: SparkSession, folder: str, page_texts: Callable[[bytes], list[tuple[str, str]]]) -> DataFrame:
    """(path, page, text, start, end) of all *.pdf below a folder. page_texts gives, for a file's bytes, two readings of each page; the second counts where
    the first has fewer than 50 characters. No PDF library is needed here: the reader is the caller's."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                start = 0
                for n, (first, second) in enumerate(page_texts(bytes(content)), 1):
                    text = first if len(first.strip()) >= 50 else second
                    out.append((path, n, text, start, start + len(text)))
                    start += len(text)
            yield pd.DataFrame(out, columns=["path", "page", "text", "start", "end"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInPandas(of, "path string, page int, text string, start long, end long")


def write_vectors(df: DataFrame, path: str, parts: int | None = None) -> None:
    """A vector index without approximation: (vec_id, embedding and what else df has) as Parquet, dealt out by a hash of the id."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.where(F.col("embedding").isNotNull()).repartition(parts, "vec_id").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """A JSON array, in the order of a column, as a folder of parts that are the array if they are put together in the order of their names. Rows are sorted across partitions,
    and only the numbers of the first and last one reach the driver."""
    lines = df.select(order, F.to_json(F.struct(*df.columns)).alias("_line")).repartitionByRange(order).sortWithinPartitions(order)
    lines = cut(lines.select("_line", F.monotonically_increasing_id().alias("_id")), "json-array")
    first, last = lines.agg(F.min("_id"), F.max("_id")).first()
    if first is None:
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    value = F.concat(F.when(F.col("_id") == first, "[").otherwise(""), "_line", F.when(F.col("_id") == last, "]").otherwise(","))
    lines.withColumn("value", value).repartitionByRange("_id").sortWithinPartitions("_id").select("value").write.mode("overwrite").text(path)
