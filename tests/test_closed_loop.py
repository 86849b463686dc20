"""Generation under budgets against a plain loop, and quotas against greedy choice."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import closed_loop, endpoints, synthesis
from tessella.operators.generation import chosen_passages
from tessella.plans import corpus, generation


def number(key, n):
    return int(hashlib.md5(f"{key}|intent".encode()).hexdigest()[:7], 16) % n


def plain(targets, intents, caps, outcome, done, batch, attempts, warmup, most):
    """Accepted and rejected (domain, pick, intent, reason) and each domain's (n, attempts, rejects, why), a candidate at a time. outcome(domain, pick, intent): the reason."""
    kept, bad, ends = [], [], {}
    for d, target in targets.items():
        subs = Counter({s: n for (e, s), n in done.items() if e == d})
        n, tries, rejects, why = sum(subs.values()), 0, 0, None
        limit = (target - n) * attempts
        if n >= target:
            why = "target"
        while why is None:
            asked, used = [], 0
            for _ in range(batch):
                if n + len(asked) >= target:
                    break
                free = [i for i in intents[d] if any(subs[s] < caps.get((d, s), 0) for s in i[1])]
                if not free:
                    why = "room"
                    break
                intent = free[number(f"{d}|{tries + used}", len(free))]
                reason = outcome(d, tries + used, intent[0])
                if reason != "skipped":
                    asked.append((tries + used, intent, reason))
                used += 1
            tries += used
            if why:
                break
            for pick, intent, reason in asked:
                if reason == "ok":
                    kept.append((d, pick, intent[0]))
                    n += 1
                    subs[intent[1][0]] += 1
                elif reason != "failed":
                    rejects += 1
                    bad.append((d, pick, intent[0], reason))
            why = "candidates" if not asked else "breaker" if tries >= warmup and rejects / tries > most else "target" if n >= target else "attempts" if tries >= limit else None
        ends[d] = (n, tries, rejects, why)
    return sorted(kept), sorted(bad), ends


def reason_of(share):
    def of(d, pick, intent):
        x = int(hashlib.md5(f"{d}{pick}{intent}".encode()).hexdigest()[:7], 16) % 100
        return "ok" if x < share[d] else "skipped" if x % 5 == 0 else "failed" if x % 11 == 0 else f"bad {x % 2}"
    return of


@pytest.mark.parametrize("batch", [4, 13])
def test_against_a_loop(spark, batch):
    r = random.Random(7)
    targets = {"a": 40, "b": 30, "c": 25, "d": 60, "e": 10, "f": 12}
    share = {"a": 85, "b": 40, "c": 97, "d": 75, "e": 90, "f": 3}
    intents = {d: [(f"i{k}", r.sample(["x", "y", "z"], r.randint(1, 2))) for k in range(3)] for d in targets}
    caps = {(d, s): {"c": 4, "f": 50}.get(d, 25) for d in targets for s in "xyz"}
    del caps["d", "x"]
    done = {("a", "x"): 11, ("a", "q"): 2, ("e", "x"): 10, ("b", "y"): 1}
    of = reason_of(share)
    want = plain(targets, intents, caps, of, done, batch, 3, 20, 0.4)
    assert {w[3] for w in want[2].values()} >= {"target", "room", "breaker"}
    f = F.udf(of, "string")
    df = lambda rows, schema: spark.createDataFrame(rows, schema)

    def make(picks):
        p = picks.withColumn("why", f("domain", "pick", "intent"))
        return p.withColumn("prompt", F.when(F.col("why") != "skipped", F.col("why"))).withColumn("allowed", F.array(F.lit("A_1"))).drop("why")

    got = closed_loop.run(
        df(list(targets.items()), "domain string, target int"), df([(d, i, s, k) for d, x in intents.items() for k, (i, s) in enumerate(x)], "domain string, intent string, subdomains array<string>, place int"),
        df([(d, s, c) for (d, s), c in caps.items()], "domain string, subdomain string, cap int"), make, lambda p: F.when(p == "failed", endpoints.FAILED).otherwise(p), lambda a, _: a, df([(d, s, n) for (d, s), n in done.items()], "domain string, subdomain string, n long"), batch=batch, warmup=20)
    assert sorted((x["domain"], x["pick"], x["intent"]) for x in got.accepted.collect()) == want[0]
    assert sorted((x["domain"], x["pick"], x["intent"], x["reason"]) for x in got.rejected.collect()) == want[1]
    assert {x["domain"]: (x["n"], x["attempts"], x["rejects"], x["why"]) for x in got.domains.collect()} == want[2]


def test_nothing_to_do(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    make = lambda p: p.withColumn("prompt", F.lit("p")).withColumn("allowed", F.array(F.lit("A_1")))
    none = closed_loop.run(df([("a", 0)], "domain string, target int"), df([("a", "i", ["x"], 0)], "domain string, intent string, subdomains array<string>, place int"), df([("a", "x", 5)], "domain string, subdomain string, cap int"), make, lambda p: p, lambda a, b: F.lit("ok"))
    assert none.accepted.count() == 0 and none.rejected.count() == 0 and none.domains.first()["why"] == "target"


def test_query_against_a_loop(spark):
    """The query's waves over documents, with the reasons of every pick that it could have made."""
    sf = "/root/testdata/sf0.001"
    ends = {r["domain"]: (r["n"], r["attempts"], r["rejects"], r["why"]) for r in generation.generation_loop(spark, sf).where("pick IS NULL").collect()}
    rows = [(r["domain"], r["pick"], r["intent"], r["reason"]) for r in generation.generation_loop(spark, sf).where("pick IS NOT NULL").collect()]
    targets, intents, caps, make = generation.loop_inputs(spark, sf)
    t, c = {r["domain"]: r["target"] for r in targets.collect()}, {(r["domain"], r["subdomain"]): r["cap"] for r in caps.collect()}
    i = defaultdict(list)
    for r in sorted(intents.collect(), key=lambda r: r["place"]):
        i[r["domain"]].append((r["intent"], r["subdomains"]))
    picks = spark.createDataFrame([(d, k, n, s[0]) for d, x in i.items() for n, s in x for k in range(3 * t[d] + generation.LOOP_BATCH)], "domain string, pick long, intent string, subdomain string")
    judged = make(picks).withColumn("response", generation.loop_answer(F.col("prompt"))).withColumn("reason", F.when(F.col("prompt").isNull(), "skipped").otherwise(synthesis.sft_reason(F.col("response"), F.col("allowed"))))
    reasons = {(r["domain"], r["pick"], r["intent"]): r["reason"] for r in judged.collect()}
    kept, bad, want = plain(t, i, c, lambda *k: reasons[k], {}, generation.LOOP_BATCH, 3, 50, 0.4)
    assert ends == want and kept and bad
    assert sorted(x for x in rows if x[3] != "ok") == bad and sorted(x[:3] for x in rows if x[3] == "ok") == kept


def test_waves_do_not_exchange_documents(spark):
    """A wave's few choices go to the documents: the same passages as by an exchange, and no exchange of documents by their id or number."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        make = generation.loop_inputs(spark, "/root/testdata/sf0.001")[3]
        made = make(spark.createDataFrame([(d, k, i, s[0]) for k, (d, i, s) in enumerate(generation.LOOP_INTENTS)], "domain string, pick long, intent string, subdomain string"))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id" not in plan and "_number" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
        docs = corpus.documents(spark, "/root/testdata/sf0.001")
        asked = made.select(F.concat_ws("|", "domain", "pick", "intent").alias("id"), "domain", "subdomain")
        want = {r["id"]: [f"DOC_{x}" for x in r["picked"]] for r in chosen_passages(asked.withColumn("cross", F.array().cast("array<bigint>")), docs).collect()}
        assert want and {"|".join((r["domain"], str(r["pick"]), r["intent"])): r["allowed"] for r in made.collect() if r["allowed"]} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


@pytest.mark.parametrize("fills", [[(0, 5), (0, 5), (0, 5)], [(3, 9), (0, 4), (7, 8)], [(9, 4), (2, 2), (0, 30)], [(0, 0)], []])
def test_least_filled_against_greedy(spark, fills):
    n = [f for f, _ in fills]
    want = []
    for _ in range(25):
        free = [k for k in range(len(n)) if n[k] < fills[k][1]]
        if not free:
            want.append(None)
            continue
        d = min(free, key=lambda k: n[k])
        n[d] += 1
        want.append(f"d{d}")
    items = spark.createDataFrame([(k * 977 % 25 * 5000, 1) for k in range(25)], "id long, place int")
    f = spark.createDataFrame([(f"d{k}", k, a, b) for k, (a, b) in enumerate(fills)], "dimension string, place int, n int, target int")
    assert [r["dimension"] for r in synthesis.least_filled(items.drop("place"), "id", f).orderBy("id").collect()] == want
