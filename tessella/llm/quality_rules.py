"""Quality rules with host verdicts, in DataFrame functions only.

Every text is measured by word and line rules. Failures are counted by host (one partial sum for each host and
task), each host's failure rate is shrunk towards the corpus rate with a beta prior whose strength is estimated
from the spread between hosts, and the hosts whose shrunk rate passes a limit are joined back to their documents.

Defined results: a null text is an empty text (0 words, base_failed). A null host is a host of its own. Equal rows
are rows of their own. An empty table gives an empty result. Other columns of the input are carried along by
`annotate` unless they have a result's name, in which case the result replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import SPACE, WORD, let, materialise, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[#*$%&|<>]"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the word list w (each word counts once).

    Windows are compared by a 64-bit hash of the three words. The windows that are found again are taken from a sort of
    (hash, place); only lists with an equal pair of windows are sorted.
    """

    def covered(p: Column) -> Column:  # p: sorted places of repeated windows
        steps = F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(3), F.get(p, i + 1) - x)).otherwise(F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            hits = F.filter(F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda x: x.isNotNull())
            return F.sort_array(hits)

        return let(let(pairs, places), covered)

    def windows(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(h, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h)))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(windows(w))


def metrics(text: Column) -> Column:
    """A struct of the five measures of a text."""

    def lines(t: Column) -> Column:
        return let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lambda l: F.size(l) - F.size(F.array_distinct(l)))

    def of(t: Column) -> Column:
        return let(words(t), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            lines(t).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ))

    return let(F.coalesce(text, F.lit("")), of)


@dataclass(frozen=True)
class HostPrior:
    """Mean failure rate of all rows, and the prior's strength in rows."""

    mean: float
    strength: float


#: Where hosts differ no more than chance explains, the prior is this strong and every host gets the mean.
STRONGEST = 1e6


def fit_prior(hosts: DataFrame) -> HostPrior:
    """Beta-binomial prior by moments, from six sums over all hosts (columns n and failed)."""
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    s = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ffn")).first()
    if not s["hosts"]:
        return HostPrior(0.0, STRONGEST)
    mean = s["f"] / s["n"]
    spread, within = s["ffn"] - mean * s["f"], mean * (1 - mean)
    scale = (s["n"] - s["nn"] / s["n"] - (s["hosts"] - 1)) * within
    rho = (spread - (s["hosts"] - 1) * within) / scale if scale > 0 else 0.0
    return HostPrior(mean, min(STRONGEST, 1 / rho - 1) if rho > 0 else STRONGEST)


def host_rates(hosts: DataFrame, prior: HostPrior) -> DataFrame:
    """Adds shrunk_rate: the posterior mean of a host's failure rate."""
    return hosts.withColumn("shrunk_rate", (F.col("failed") + F.lit(prior.mean * prior.strength)) / (F.col("n") + F.lit(prior.strength)))


#: Rejected hosts up to this number (names of some dozen bytes) are sent to all tasks; beyond it both sides are dealt out by host and a salt.
SENT_HOSTS, SALTS = 100_000, 64


def _with_verdicts(measured: DataFrame, bad: DataFrame, sent: int = SENT_HOSTS) -> DataFrame:
    """measured with host_rejected. Documents aren't dealt out by host alone: one host may have a third of them."""
    n = bad.count()
    if not n:
        return measured.withColumn("host_rejected", F.lit(False))
    same = F.col("_host").eqNullSafe(F.col("_bad"))
    if n <= sent:
        joined = measured.join(F.broadcast(bad), same, "left")
    else:
        salted = bad.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("_salt", F.pmod(F.xxhash64(*METRICS, "_host"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_salt") == F.col("_salt2")), "left")
    return joined.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))


def annotate(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, max_host_rate: float = 0.5) -> DataFrame:
    """docs (the columns in keep, all by default) with the measures, base_failed, host_rejected and kept.

    max_host_rate: hosts whose shrunk failure rate is above it lose all their documents.
    """
    names = [*METRICS, "base_failed", "host_rejected", "kept"]
    carried = [c for c in (docs.columns if keep is None else keep) if c not in names]
    measured = docs.select(*carried, docs[host].alias("_host"), metrics(docs[text]).alias("_m"))
    measured = measured.select(*carried, "_host", *[F.col(f"_m.{m}").alias(m) for m in METRICS])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = materialise(measured.withColumn("base_failed", failed), "quality")
    hosts = measured.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    bad = host_rates(hosts, fit_prior(hosts)).where(F.col("shrunk_rate") > max_host_rate).select(F.col("_host").alias("_bad"), F.lit(True).alias("host_rejected"))
    joined = _with_verdicts(measured, materialise(bad, "quality-hosts"))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).select(*carried, *names)
