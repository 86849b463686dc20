"""Quality figures, each over all rows by grouping sets: a row a group and one overall (group null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import slots as S


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0, to six places."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)


def confusion(labelled: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    """labelled (expected, predicted): a row an expected class, a column a predicted one."""
    return labelled.groupBy("expected").pivot("predicted", list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def per_class(labelled: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1) from one pass: every row is one for its expected and one for its predicted class."""
    sides = F.explode(F.array(F.struct(F.col("expected").alias("class"), F.lit(True).alias("true")), F.struct(F.col("predicted").alias("class"), F.lit(False).alias("true"))))
    c = labelled.select((F.col("expected") == F.col("predicted")).alias("hit"), sides.alias("s")).groupBy("s.class").agg(
        F.count_if(F.col("s.true")).alias("support"), F.count_if(~F.col("s.true")).alias("predicted"), F.count_if(F.col("s.true") & F.col("hit")).alias("tp"))
    p, r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    return c.select("class", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def slot_scores(rows: DataFrame) -> DataFrame:
    """rows (example_id, domain, expected map, predicted map; intent inside): precision, recall, value and intent accuracy by domain and overall."""
    keys = F.array_except(F.array_union(F.map_keys("expected"), F.map_keys("predicted")), F.array(F.lit("intent")))
    at = lambda m, k: F.try_element_at(F.col(m), k)
    cells = F.transform(keys, lambda k: F.struct(at("expected", k).isNotNull().alias("e"), at("predicted", k).isNotNull().alias("p"), S.same_value(at("predicted", k), at("expected", k)).alias("v")))
    n = lambda test: F.sum(F.size(F.filter("cells", test)))
    tp = n(lambda c: c["e"] & c["p"])
    same_intent = F.lower(at("expected", F.lit("intent"))) == F.lower(at("predicted", F.lit("intent")))
    grouped = rows.withColumns({"cells": cells, "same_intent": same_intent, "has_intent": at("expected", F.lit("intent")).isNotNull()}).groupingSets([["domain"], []], "domain")
    return grouped.agg(
        F.count(F.lit(1)).alias("n"), ratio(tp, n(lambda c: c["p"])).alias("precision"), ratio(tp, n(lambda c: c["e"])).alias("recall"),
        ratio(n(lambda c: c["e"] & c["p"] & c["v"]), tp).alias("value_accuracy"), ratio(F.count_if("same_intent"), F.count_if("has_intent")).alias("intent_accuracy"))


def gate_scores(rows: DataFrame) -> DataFrame:
    """rows (domain, expected, sufficient, expected_missing, first_missing)."""
    e, p = F.col("expected"), F.col("sufficient")
    asked = ~e & ~p & F.col("expected_missing").isNotNull()
    return rows.groupingSets([["domain"], []], "domain").agg(
        F.count(F.lit(1)).alias("n"), ratio(F.count_if(e == p), F.count(F.lit(1))).alias("accuracy"), ratio(F.count_if(~e & p), F.count_if(~e)).alias("false_sufficient"),
        ratio(F.count_if(e & ~p), F.count_if(e)).alias("false_insufficient"), ratio(F.count_if(asked & (F.col("expected_missing") == F.col("first_missing"))), F.count_if(asked)).alias("missing_slot_accuracy"))


def scorecard(rows: DataFrame) -> DataFrame:
    """rows (domain, has_citation, has_fabrication, expected_cited, verdict_ok, grounded_clean, key_facts_rate)."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return rows.groupingSets([["domain"], []], "domain").agg(
        F.count(F.lit(1)).alias("n"), share("has_citation").alias("citation_coverage"), F.count_if("has_fabrication").alias("fabrications"), share("has_fabrication").alias("fabrication_rate"),
        share("expected_cited").alias("expected_cites_hit"), share("verdict_ok").alias("verdict_accuracy"), share("grounded_clean").alias("grounded_clean"),
        F.round(F.sum(F.coalesce("key_facts_rate", F.lit(0.0))) / F.greatest(F.lit(1), F.count("key_facts_rate")), 6).alias("key_facts_mean"))


def deltas(rows: DataFrame, base: str, system: str) -> DataFrame:
    """rows (metric, system, value) side by side with their difference."""
    p = rows.groupBy("metric").pivot("system", [base, system]).agg(F.first("value"))
    return p.select("metric", F.col(base).alias("base"), F.col(system).alias("system"), F.round(F.col(system) - F.col(base), 6).alias("delta"))


def fixed_and_broken(rows: DataFrame) -> DataFrame:
    """rows (id, base_ok, system_ok): what the system repairs and what it breaks."""
    return rows.where(F.col("base_ok") != F.col("system_ok")).select("id", F.when(F.col("system_ok"), "fixed").otherwise("broken").alias("change"))


def winner(rows: DataFrame, incumbent: str) -> DataFrame:
    """rows (metric, system, value): the best system of a metric; only a strictly better one replaces the incumbent, then the first by name."""
    best = F.max(F.struct("value", (F.col("system") == incumbent).alias("own"), F.expr("-ascii(system)").alias("late"), "system"))
    return rows.groupBy("metric").agg(best.alias("b")).select("metric", F.col("b.system").alias("winner"), "b.value")


def judge_means(rows: DataFrame, systems: tuple[str, str]) -> DataFrame:
    """rows (domain, system, score of 1 to 5 or null): means of the scores, as shares to two places with 3 for null, side by side by domain and overall."""
    share = F.bround(F.coalesce("score", F.lit(3)) / 5, 2)
    g = rows.withColumn("s", share).groupingSets([["domain"], []], "domain").agg(*[F.round(F.avg(F.when(F.col("system") == s, F.col("s"))), 6).alias(s) for s in systems])
    return g.withColumn("delta", F.round(F.col(systems[1]) - F.col(systems[0]), 6))
