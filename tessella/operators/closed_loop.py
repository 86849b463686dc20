"""A generator's loop under budgets, in waves over all domains at once.

What a wave may try depends on what earlier waves left: a domain picks, for each of `batch` candidates, an intent among those that still have room in a subdomain; full
ones are never drawn, so they use up no attempts. Candidates are made, answered and judged by what the caller gives; accepted ones fill the intent's first subdomain. A domain ends with its target,
its attempts, its room, a wave without a candidate to answer, or once the breaker finds too many rejects. State is a row a domain and one a subdomain, written
to the shared folder after each wave along with the wave, so a lost executor repeats one wave at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import tables as T
from tessella.operators import endpoints, synthesis
from tessella.operators.storage import cut

BATCH, ATTEMPTS = 4, 3

#: Reasons that are no verdict of the judge: no candidate was made, or its call failed.
SKIPPED, FAILED = "skipped", "failed"


@dataclass
class Generated:
    accepted: DataFrame
    rejected: DataFrame  # with the judge's reason
    domains: DataFrame  # (domain, target, n, attempts, rejects, why)


def subdomain_caps(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(domain, subdomain, cap): as many examples as its documents allow, up to the domain's cap. docs (domain, subdomain), limits (domain, abs_cap, per_doc)."""
    n = docs.groupBy("domain", "subdomain").agg(F.count(F.lit(1)).alias("_docs"))
    return n.join(limits, "domain").select("domain", "subdomain", F.least(F.col("abs_cap"), F.col("_docs") * F.col("per_doc")).cast("long").alias("cap"))


def picked(domain: Column, pick: Column, n: Column) -> Column:
    """The place, from 0, of the intent that a pick draws among n."""
    return synthesis.draw(F.concat_ws("|", domain, pick.cast("string")), "intent", n)


def run(
    targets: DataFrame, intents: DataFrame, caps: DataFrame, make: Callable[[DataFrame], DataFrame], answer: Callable[[Column], Column], judge: Callable[[Column, Column], Column], done: DataFrame | None = None,
    batch: int = BATCH, attempts: int = ATTEMPTS, warmup: int = T.REJECT_WARMUP, most_rejects: float = T.MAX_REJECT_RATE,
) -> Generated:
    """targets (domain, target); intents (domain, intent, subdomains: the first is filled, place: the order of draws); caps (domain, subdomain, cap); done (domain, subdomain, n): what earlier runs accepted.

    make gets (domain, pick, intent, subdomain) and adds `prompt` (null: no candidate), `allowed` and what else a record should have. answer and judge are Columns of the prompt, and of
    the response and allowed. An intent, or a domain, that caps doesn't name has no room.
    """
    done = caps.select("domain", "subdomain", F.lit(0).cast("long").alias("n")).limit(0) if done is None else done.groupBy("domain", "subdomain").agg(F.sum("n").alias("n"))
    had = done.groupBy("domain").agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    state = cut(targets.join(had, "domain", "left").select("domain", F.col("target").cast("long").alias("target"), n.alias("n"), ((F.col("target") - n) * attempts).cast("long").alias("most"), zero.alias("attempts"), zero.alias("rejects"),
                                                           F.when(n >= F.col("target"), "target").alias("why")), "loop-domains")
    subs = cut(caps.join(done, ["domain", "subdomain"], "left").select("domain", "subdomain", F.col("cap").cast("long").alias("cap"), n.alias("n")), "loop-subdomains")
    waves: list[DataFrame] = []
    while not state.where("why IS NULL").isEmpty():
        waves.append(cut(_wave(state, subs, intents, make, answer, judge, batch), "loop-wave"))
        state, subs = _after(waves[-1], state, subs, warmup, most_rejects)
    if not waves:
        waves.append(cut(_wave(state, subs, intents, make, answer, judge, batch), "loop-wave"))
    every = waves[0]
    for w in waves[1:]:
        every = every.unionByName(w)
    return Generated(every.where("reason = 'ok'").drop("reason"), every.where(~F.col("reason").isin("ok", SKIPPED, FAILED)), state.select("domain", "target", "n", "attempts", "rejects", "why"))


def _wave(state: DataFrame, subs: DataFrame, intents: DataFrame, make, answer, judge, batch: int) -> DataFrame:
    room = subs.where("n < cap").groupBy("domain").agg(F.collect_set("subdomain").alias("_room"))  # names in the table of intents
    left = intents.join(room, "domain").where(F.arrays_overlap("subdomains", "_room")).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("place", "intent", F.get("subdomains", 0).alias("subdomain")))).alias("_choices"))
    tries = state.where("why IS NULL").join(left, "domain").select("domain", "_choices", F.explode(F.sequence(F.col("attempts"), F.col("attempts") + batch - 1)).alias("pick"))
    one = F.get("_choices", picked(F.col("domain"), F.col("pick"), F.size("_choices")))
    made = make(tries.select("domain", "pick", one["intent"].alias("intent"), one["subdomain"].alias("subdomain")))
    before = Window.partitionBy("domain").orderBy("pick").rowsBetween(Window.unboundedPreceding, -1)  # `batch` rows a domain
    made = made.withColumn("_before", F.coalesce(F.sum(F.col("prompt").isNotNull().cast("long")).over(before), F.lit(0)))
    goal = state.select("domain", (F.col("target") - F.col("n")).alias("_left"))
    kept = made.join(goal, "domain").where(F.col("_before") < F.col("_left")).drop("_before", "_left")
    said = kept.withColumn("response", answer(F.col("prompt")))
    reason = F.when(F.col("prompt").isNull(), SKIPPED).when(F.col("response").isNull() | (F.col("response") == endpoints.FAILED), FAILED).otherwise(judge(F.col("response"), F.col("allowed")))
    return said.withColumn("reason", reason)


def _after(wave: DataFrame, state: DataFrame, subs: DataFrame, warmup: int, most_rejects: float) -> tuple[DataFrame, DataFrame]:
    good = F.count_if(F.col("reason") == "ok")
    tally = wave.groupBy("domain").agg(good.alias("_ok"), F.count(F.lit(1)).alias("_tries"), F.count_if(F.col("reason") != SKIPPED).alias("_asked"), F.count_if(~F.col("reason").isin("ok", SKIPPED, FAILED)).alias("_bad"))
    add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    now = state.join(tally, "domain", "left").select("domain", "target", add("n", "_ok"), "most", add("attempts", "_tries"), add("rejects", "_bad"), "why", "_tries", "_asked")
    breaks = (F.col("attempts") >= warmup) & (F.col("rejects") / F.col("attempts") > most_rejects)
    why = F.when(F.col("why").isNotNull(), F.col("why")).when(F.col("_tries").isNull(), "room").when(F.col("_asked") == 0, "candidates").when(breaks, "breaker").when(F.col("n") >= F.col("target"), "target").when(F.col("attempts") >= F.col("most"), "attempts")
    filled = wave.groupBy("domain", "subdomain").agg(good.alias("_ok"))
    return cut(now.select("domain", "target", "n", "most", "attempts", "rejects", why.alias("why")), "loop-domains"), cut(subs.join(filled, ["domain", "subdomain"], "left").select("domain", "subdomain", "cap", add("n", "_ok")), "loop-subdomains")
