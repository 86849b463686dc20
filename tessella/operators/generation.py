"""Steps between retrieval and an answer, and of making training data under budgets.

Groups may be hot: first rows of a key meet as partial minima, and rows are numbered within slices of their group whose counts are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions import tables as T
from tessella.operators import knowledge

SLICE = 4096


def numbered(df: DataFrame, group: list[str], slice_: Column, order: list[str], name: str) -> DataFrame:
    """df with the place, from 0, of each row of its group in the order of (slice_, order). Group columns must not be null."""
    rows = df.withColumn("_slice", slice_)
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(sums, [*group, "_slice"]).withColumn(name, F.col("_place") + F.col("_first")).drop("_slice", "_place", "_first")


def conditions(passages: DataFrame, intents: tuple[str, ...] = T.REASONING_INTENTS) -> DataFrame:
    """Conditions of passages (query_id, rank, doc_id, domain, asked, intent, conditions) that apply: of questions with a reasoning intent, of related
    domains (a general question or passage is related to all); each has its passage's id unless it names one, and of equal (field, operator) of a
    question the first by rank and place stays."""
    related = (F.col("asked") == "general") | (F.col("domain") == "general")
    for d, ds in T.RELATED_DOMAINS.items():
        related = related | ((F.col("asked") == d) & F.col("domain").isin(*ds))
    one = passages.where(F.col("intent").isin(*intents) & related).select("query_id", "rank", "doc_id", F.posexplode("conditions").alias("pos", "c"))
    whole = F.struct("rank", "pos", F.col("c").withField("doc_id", F.coalesce(F.col("c.doc_id"), "doc_id")).alias("c"))
    return one.groupBy("query_id", F.col("c.field").alias("field"), F.col("c.operator").alias("operator")).agg(F.min_by(whole, F.struct("rank", "pos")).alias("x")).select("query_id", "x.rank", "x.pos", "x.c.*")


def reasoned(questions: DataFrame, found: DataFrame) -> DataFrame:
    """questions (query_id, slots: a string map) with `r`, the resolution of their conditions; a question without any escalates, one whose `intent`, if there is such a column, isn't
    reasoned about has no resolution. A question's conditions are as many as there are fields and operators at most."""
    met = found.join(questions.select("query_id", "slots"), "query_id")
    value = F.try_element_at("slots", F.col("field"))
    one = F.struct("rank", "pos", "field", "operator", "value", "doc_id", "mandatory", value.alias("slot_value"), R.status(value, F.col("operator"), F.col("value")).alias("status"))
    kept = met.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("_c"))
    none = F.array().cast(kept.schema["_c"].dataType)
    runs = F.col("intent").isin(*T.REASONING_INTENTS) if "intent" in questions.columns else F.lit(True)
    return questions.join(kept, "query_id", "left").withColumn("r", F.when(runs, R.resolved(F.coalesce("_c", none)))).drop("_c")


def trace_text(r: Column) -> Column:
    """A resolution as the text that a generator reads."""
    show = lambda c: F.coalesce(c, F.lit("None"))
    rule = lambda c: F.concat_ws(" ", c["field"], c["operator"], show(c["value"]))
    part = lambda title, rows, line: F.when(F.size(rows) > 0, F.concat_ws("\n", F.lit(title), F.array_join(F.transform(rows, line), "\n")))
    return F.concat_ws(
        "\n", F.lit("ELIGIBILITY REASONING TRACE:"), F.concat(F.lit("  Decision : "), r["decision"]), F.when(r["eligible"].isNotNull(), F.concat(F.lit("  Eligible : "), F.initcap(r["eligible"].cast("string")))),
        F.concat(F.lit("  Coverage : "), r["coverage"].cast("string")),
        part("  Met conditions:", r["met"], lambda c: F.concat(F.lit("    ✓ "), rule(c), F.lit(" ["), c["doc_id"], F.lit("]"))),
        part("  Failed conditions:", r["failed"], lambda c: F.concat(F.lit("    ✗ "), rule(c), F.lit(" ["), c["doc_id"], F.lit("] (user value: "), show(c["slot_value"]), F.lit(")"))),
        part("  Warnings (non-blocking):", r["warnings"], lambda c: F.concat(F.lit("    ⚠ "), rule(c), F.lit(" ["), c["doc_id"], F.lit("]"))),
        part("  Unresolved:", r["unresolved"], lambda c: F.concat(F.lit("    ? "), c["field"], F.lit(" — slot missing"))))


def json_indented(slots: Column) -> Column:
    """A string map without its nulls, as JSON with an indent of two."""
    kept = F.map_filter(slots, lambda _, v: v.isNotNull())
    lines = F.transform(F.map_entries(kept), lambda e: F.concat(F.lit("  "), F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(": "), F.regexp_replace(F.to_json(F.array(e["value"])), r"^\[|\]$", "")))
    return F.when(F.size(lines) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}")))


def with_tools(found: DataFrame, tools: DataFrame, fallback: DataFrame) -> DataFrame:
    """What an agent's rounds found (query_id, rank, doc_id, domain, subdomain, effective_date), with its tools' outputs behind; questions with neither
    have the fallback's hits."""
    after = tools.withColumn("rank", F.lit(1 << 30) + F.col("rank"))
    both = found.unionByName(after)
    return both.unionByName(fallback.join(both.select("query_id").distinct(), "query_id", "left_anti").select(*both.columns))


def tool_passage(rows: DataFrame, order: int = 0) -> DataFrame:
    """Rows (query_id, text) as the tool's pseudo-passages, text being their content: they have an id and a subdomain of their own, and no date."""
    return rows.select("query_id", F.lit(order).cast("long").alias("rank"), F.lit(T.TOOL_DOC).alias("doc_id"), F.lit("payslip").alias("domain"), F.lit("tool_output").alias("subdomain"), F.lit(None).cast("string").alias("effective_date"), F.col("text").alias("content"))


def formatted_policy(asked: DataFrame, policies: DataFrame, keep: bool = False) -> DataFrame:
    """asked (identifier) with the policy's text as a tool gives it, by doc_id or else by section_id (the first row of an id, by _ord), or that there is none;
    `doc`, the policy itself, is kept if asked for."""
    shown = ("doc_id", "title", "domain", "effective_date", "content")
    cols = [*shown, *["subdomain"] * keep]
    by = lambda key, name: knowledge.one_per_key(policies.where(F.col(key).isNotNull()), key, ["_ord"]).select(F.col(key).alias("_id"), F.struct(*cols).alias(name))
    met = asked
    for key, name in (("doc_id", "_d"), ("section_id", "_s")):
        right = by(key, name)
        met = met.join(right, met["identifier"] == right["_id"], "left").drop("_id")
    p, show = F.coalesce("_d", "_s"), lambda c: F.coalesce(c, F.lit("None"))
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), show(p[c])) for c in shown[:4]], F.lit("content:"), F.coalesce(p["content"], F.lit("")))
    met = met.withColumn("text", F.when(p.isNull(), F.concat(F.lit("[GetPolicy] No document found for '"), F.col("identifier"), F.lit("'"))).otherwise(text))
    return (met.withColumn("doc", p) if keep else met).drop("_d", "_s")


def draw(key: Column, name: str, n: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(name))), 1, 7), 16, 10).cast("long"), n)


def places(docs: DataFrame) -> DataFrame:
    """(domain, subdomain, doc_id, _number): documents numbered within their subdomain, by a hash of their ids."""
    spot = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2)
    return numbered(docs.select("domain", "subdomain", "doc_id"), ["domain", "subdomain"], spot, ["doc_id"], "_number")


def chosen_passages(asked: DataFrame, docs: DataFrame, most: int = 3, placed: DataFrame | None = None) -> DataFrame:
    """(id, picked): two or three documents of the asked (domain, subdomain), chosen by hashes without repeats, then those of `cross`, if asked has it, that exist and
    aren't among them. Documents are numbered within their subdomain, and choices are joined by number: no list of a subdomain's documents is made.

    placed: places(docs), made once by a caller who asks for a few passages again and again. Choices are then sent to the documents' numbers, which aren't exchanged.
    """
    few = F.broadcast if placed is not None else lambda rows: rows
    sizes = (docs if placed is None else placed).groupBy("domain", "subdomain").agg(F.count(F.lit(1)).alias("_size"))
    placed = places(docs) if placed is None else placed
    drawn = asked.join(sizes, ["domain", "subdomain"])
    n = F.least(draw(F.col("id"), "n", F.lit(2)) + 2, F.lit(most), F.col("_size"))
    first, step = draw(F.col("id"), "first", F.col("_size")), 1 + draw(F.col("id"), "step", F.greatest(F.lit(1), F.floor((F.col("_size") - 1) / 2)))
    drawn = drawn.withColumns({"_n": n, "_f": first, "_s": step}).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    drawn = drawn.withColumn("_number", F.pmod(F.col("_f") + F.col("_k") * F.col("_s"), F.col("_size")))
    picked = few(drawn).join(placed, ["domain", "subdomain", "_number"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_k", "doc_id"))).alias("p"))
    picked = picked.select("id", F.col("p.doc_id").alias("picked"))
    if "cross" not in asked.columns:
        return picked
    cross = asked.select("id", F.posexplode("cross").alias("pos", "doc_id")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))).alias("c"))
    more = F.coalesce(F.col("c.doc_id"), F.array().cast("array<bigint>"))
    return picked.join(cross, "id", "left").select("id", F.concat("picked", F.array_except(more, "picked")).alias("picked"))


def reused(asked: DataFrame, accepted: DataFrame) -> DataFrame:
    """asked (id, intent, slot_key, template) with `answer` and `source`: an accepted answer of the same intent and slots (accepted: intent, slot_key, response,
    _ord; the last row of a key wins, rows without a response don't count), or the template's."""
    last = accepted.where("response IS NOT NULL").groupBy("intent", "slot_key").agg(F.max_by("response", "_ord").alias("_response"))
    met = asked.join(last, ["intent", "slot_key"], "left")
    return met.withColumns({"answer": F.coalesce("_response", "template"), "source": F.when(F.col("_response").isNotNull(), "reuse").otherwise("template")}).drop("_response")


def budgeted(attempts: DataFrame, target: int, cap: int, most: int = 3, done: DataFrame | None = None) -> DataFrame:
    """The attempts (domain, subdomain, attempt: a whole number, accepted) that a generator keeps: the accepted ones among the first most * (target - done) of a
    domain, while its subdomain has less than cap and the domain less than target. done (domain, subdomain, n): what a former run kept, so that
    a run goes on where it stopped."""
    at = F.floor(F.col("attempt") / SLICE)
    if done is None:
        done = attempts.select("domain", "subdomain", F.lit(0).cast("long").alias("n")).limit(0)
    by_domain = done.groupBy("domain").agg(F.sum("n").alias("_done"))
    rows = numbered(attempts, ["domain"], at, ["attempt"], "_try").join(by_domain, "domain", "left").withColumn("_left", F.greatest(F.lit(0), F.lit(target) - F.coalesce("_done", F.lit(0))))
    good = rows.where((F.col("_try") < F.lit(most) * F.col("_left")) & F.col("accepted")).drop("_done", "_try")
    good = numbered(good, ["domain", "subdomain"], at, ["attempt"], "_of_sub").join(done.withColumnRenamed("n", "_done"), ["domain", "subdomain"], "left")
    good = good.where(F.col("_of_sub") + F.coalesce("_done", F.lit(0)) < cap).drop("_of_sub", "_done")
    return numbered(good, ["domain"], at, ["attempt"], "_of_domain").where(F.col("_of_domain") < F.col("_left")).drop("_of_domain", "_left")


def merged_runs(first: DataFrame, second: DataFrame, dropped: str = "payslip") -> DataFrame:
    """Both runs' rows, without the first run's of one domain; repeated rows stay."""
    return first.where(~F.col("domain").eqNullSafe(dropped)).unionByName(second)


def shuffle_key(key: Column) -> Column:
    """What a final shuffle orders by."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit("shuffle")))


def typed_mean(rows: DataFrame) -> DataFrame:
    """rows (key, flag, number): the rate where every row has a flag, else the mean of the numbers, else null."""
    n = F.count(F.lit(1))
    return rows.groupBy("key").agg(F.round(F.when(F.count("flag") == n, F.avg(F.col("flag").cast("int"))).otherwise(F.avg("number")), 6).alias("mean"))


def first_failures(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first `most` failures of each group: a report's sample."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def always_sufficient(rows: DataFrame) -> DataFrame:
    """The gate's baseline: nothing is ever missing."""
    return rows.withColumn("gate", F.struct(F.lit(True).alias("sufficient"), F.lit(None).cast("string").alias("question"), F.array().cast("array<string>").alias("missing")))
