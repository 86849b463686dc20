"""An append-only log of batches: a batch that is written again replaces itself, and keys are in the log once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import knowledge


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders of batches that were written to the end, by name. A batch whose write was cut off has no mark of success and doesn't count."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and s.getPath().getName().startswith("batch=")]
    return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def folder(path: str, batch: int) -> str:
    """The folder of a numbered batch, whose name sorts by number."""
    return f"{path.rstrip('/')}/batch={batch:012d}"


def newest(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of the last committed batch (of those with a smaller number); none where there is none."""
    found = [p for p in committed(spark, path) if before is None or p.rstrip("/").rsplit("/", 1)[-1] < folder("", before).lstrip("/")]
    return spark.read.schema(schema).parquet(found[-1]) if found else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed batches; none where there is no log yet."""
    folders = committed(spark, path)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def append(df: DataFrame, key: str, path: str, batch: str | int, order: list[str]) -> DataFrame:
    """Writes, as one batch, the rows whose key no other batch has, and returns what that batch then holds.

    Of rows with an equal key (null is one too) the first by the order columns, which number rows uniquely, is written. Written again, complete or cut off before, a batch gets the rows that it
    got, so writers may repeat a batch until it succeeds. Batches of one log are written one after another.
    """
    spark, own = df.sparkSession, f"batch={batch}"
    others = [p for p in committed(spark, path) if p.rstrip("/").rsplit("/", 1)[-1] != own]
    new = knowledge.one_per_key(df, key, order)
    if others:
        old = spark.read.schema(df.schema).parquet(*others).select(F.col(key).alias("_old"))
        new = new.join(old, F.col(key).eqNullSafe(F.col("_old")), "left_anti")
    new.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{own}")
    return spark.read.schema(df.schema).parquet(f"{path.rstrip('/')}/{own}")


def append_stream(stream: DataFrame, key: str, path: str, checkpoint: str, order: list[str]):
    """A started query that appends a stream's batches under their numbers: a batch that is repeated after a failure changes nothing."""
    return stream.writeStream.foreachBatch(lambda df, n: append(df, key, path, n, order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
