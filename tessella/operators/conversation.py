"""State of conversations by turns, as window functions: slots that accumulate, reset with the domain, and keep their first value where sticky.

A conversation is bounded by its turns; nothing is grouped across conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import tables as T


def merged(turns: DataFrame, session: str, turn: str, slots: list[str]) -> DataFrame:
    """turns (session, turn, domain, slots of that turn) with each slot's accumulated value. A turn of another domain than the one before starts
    afresh; of the sticky slots the first value stays, of others the last; null doesn't overwrite."""
    by = Window.partitionBy(session).orderBy(turn)
    new = ~F.col("domain").eqNullSafe(F.lag("domain").over(by)) & F.lag(F.lit(1)).over(by).isNotNull()
    rows = turns.withColumn("_new", new.cast("int"))
    rows = rows.withColumn("segment", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy(session, "segment").orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    pick = lambda s: (F.first if s in T.STICKY_SLOTS else F.last)(s, ignorenulls=True).over(so_far)
    return rows.withColumns({s: pick(s) for s in slots}).drop("_new")


def history(turns: DataFrame, session: str, turn: str, role: str, text: str, n: int = 4) -> DataFrame:
    """Adds history: the n messages before each, as (role, text)."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct(F.col(role).alias("role"), F.col(text).alias("text"))).over(w))
