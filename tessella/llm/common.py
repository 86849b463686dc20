"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: ASCII white space as the contracts count it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where that is unset and all tasks run in this process
    (as in tests), a new temporary folder that is then set for the session. Elsewhere the setting is needed: a folder of one machine loses what others write."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back. Survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: a lambda variable can't be inlined into every place that uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The runs of characters that are not ASCII white space."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def gapless(df: DataFrame, group: list[str], order: list[str], name: str, salts: int | None = None, slices: list[str] | None = None) -> DataFrame:
    """Number the rows of each group from 0 without gaps, also where one group holds most of the rows.

    Rows are split into slices of their group, slices are counted, and a prefix sum over the counts gives each slice its first number. Rows are numbered
    by slice, then by the order columns. Slices are those of the columns named in `slices` (never null); without any, `salts` slices by a hash of the
    order columns, which only set the parallelism.
    """
    if not slices:
        salts = salts or max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        df, slices = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")), ["_slice"]
    counts = df.groupBy(*group, *slices).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(g).alias(f"_g_{g}") for g in [*group, *slices]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*group, *slices).orderBy(*order)
    numbered = df.withColumn("_place", F.row_number().over(within) - 1)
    # Plain equality where null can't be: the window's partitioning then serves the join too, and rows are exchanged once.
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) if g in group and df.schema[g].nullable else F.col(g) == F.col(f"_g_{g}") for g in [*group, *slices]]
    joined = numbered.join(first, on=same, how="inner")
    return joined.withColumn(name, (F.col("_place") + F.col("_first")).cast("long")).drop("_place", "_first", *slices, *[f"_g_{g}" for g in [*group, *slices]])
