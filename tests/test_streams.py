"""Streams that stop and start again against batch results, and the log of batches."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import synthesis
from tessella.sources import files, log
from tessella.streaming import state


def drain(spark, stream, at):
    """Runs a stream over what is there; a later call goes on from the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKS)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def test_breaker_across_restarts(spark, tmp_path):
    r = random.Random(4)
    share = {"a": 0.1, "b": 0.5, "c": 0.45, "d": 0.38, "e": 0.9}
    rows = [(g, k, r.random() < share[g]) for k in range(400) for g in share]
    schema = "group string, attempt long, rejected boolean"
    src, at = f"{tmp_path}/in", f"{tmp_path}/q"
    for lo, hi in ((0, 30), (30, 61), (61, 400)):  # each part is a run of its own
        spark.createDataFrame([x for x in rows if lo <= x[1] < hi], schema).write.mode("append").parquet(src)
        out = drain(spark, state.breaker_stream(spark.readStream.schema(schema).parquet(src)), at)
    got = {x["group"]: (x["n"], x["stop"]) for x in out.groupBy("group").agg(F.max("n").alias("n"), F.max(F.when(F.col("stopped"), F.col("n"))).alias("stop")).collect()}
    batch = {x["group"]: x["stopped_at"] for x in synthesis.breaker(spark.createDataFrame(rows, schema), "group", "attempt").collect()}
    assert got == {g: (s or 400, s) for g, s in batch.items()}
    assert any(batch.values()) and not all(batch.values())
    assert out.count() == sum(n for n, _ in got.values())


def test_sessions_expire_and_are_read_back(spark, tmp_path):
    src, at = f"{tmp_path}/in", f"{tmp_path}/q"
    schema = "session string, ts timestamp"
    part = lambda rows: spark.createDataFrame(rows, "session string, s long").select("session", F.timestamp_seconds(F.col("s") + 10_000).alias("ts")).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: state.session_stream(spark.readStream.schema(schema).parquet(src), live=600)
    part([("a", 0), ("a", 60), ("b", 10), ("c", 500)])
    drain(spark, stream(), at)
    part([("a", 590), ("d", 900)])
    drain(spark, stream(), at)
    part([("d", 1190)])
    out = drain(spark, stream(), at)
    events = {(x["session"], x["event"], x["messages"]) for x in out.collect()}
    assert {("a", "opened", 2), ("a", "seen", 3), ("b", "expired", 1), ("d", "opened", 1)} <= events and not any(s == "d" and e == "expired" for s, e, _ in events)
    live = {x["session"]: (x["first"], x["last"], x["messages"]) for x in state.live_sessions(spark, f"{at}/checkpoint").collect()}
    assert live["d"] == (10_900_000, 11_190_000, 2) and "b" not in live
    part([("e", 5000)])
    drain(spark, stream(), at)
    assert set(x["session"] for x in state.live_sessions(spark, f"{at}/checkpoint").collect()) == {"e"}


NEEDED = {"withdraw": ["service_years", "kyc"], "refund": ["pan"], "hello": []}


def plain_turns(rows):
    out, known = [], {}
    for session, turn, intent, slots in sorted(rows, key=lambda x: x[:2]):
        k = known.setdefault(session, {})
        if intent is not None and intent != k.get("_intent"):
            k = known[session] = {"_intent": intent}
        if "_intent" not in k:
            continue
        k.update({n: v for n, v in (slots or {}).items() if v is not None})
        missing = [n for n in NEEDED.get(k["_intent"], []) if n not in k]
        out.append((session, turn, k["_intent"], "ASK" if missing else "ANSWER", {"kyc": "Is KYC done?"}.get(missing[0], f"Could you provide your {missing[0].replace('_', ' ')}?") if missing else None))
        if not missing:
            known[session] = {}
    return sorted(out)


def test_ask_and_go_on_across_restarts(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"s{s}", t, r.choice([None, None, None, "withdraw", "refund", "hello", "other"]), r.choice([None, {"kyc": "done"}, {"service_years": "5"}, {"pan": None}, {"pan": "A", "kyc": "x"}])) for s in range(40) for t in range(12)]
    schema, src, at = "session string, turn long, intent string, slots map<string,string>", f"{tmp_path}/in", f"{tmp_path}/q"
    for lo, hi in ((0, 3), (3, 4), (4, 12)):
        spark.createDataFrame([x for x in rows if lo <= x[1] < hi], schema).repartition(3).write.mode("append").parquet(src)
        out = drain(spark, state.ask_and_go_on(spark.readStream.schema(schema).parquet(src), NEEDED, {"kyc": "Is KYC done?"}), at)
    got = sorted(tuple(x) for x in out.collect())
    assert got == plain_turns(rows) and {x[3] for x in got} == {"ASK", "ANSWER"}


def test_log_of_batches(spark, tmp_path):
    at, schema = f"{tmp_path}/log", "id long, v string"
    df = lambda *rows: spark.createDataFrame(rows, schema)
    held = lambda: sorted(tuple(x) for x in log.read(spark, at, schema).collect())
    assert held() == []
    log.append(df((1, "b"), (1, "a"), (2, "c")), "id", at, 0, ["id", "v"])
    assert held() == [(1, "a"), (2, "c")]
    log.append(df((2, "d"), (3, "e"), (3, "e2"), (3, "e")).distinct(), "id", at, 1, ["id", "v"])
    assert held() == [(1, "a"), (2, "c"), (3, "e")]
    for _ in range(2):  # a batch that is written again
        log.append(df((2, "d"), (3, "e"), (4, "f")), "id", at, 1, ["id", "v"])
        assert held() == [(1, "a"), (2, "c"), (3, "e"), (4, "f")]
    (tmp_path / "log" / "batch=1" / "_SUCCESS").unlink()  # as if the writer was lost before the end
    assert held() == [(1, "a"), (2, "c")]
    log.append(df((2, "d"), (3, "e"), (None, "n")), "id", at, 1, ["id", "v"])
    log.append(df((3, "g"), (None, "m")), "id", at, 2, ["id", "v"])
    assert log.read(spark, at, schema).orderBy("id").collect() == [(None, "n"), (1, "a"), (2, "c"), (3, "e")]
    assert log.append(df().limit(0), "id", at, 3, ["id", "v"]).count() == 0


def test_log_of_a_stream_that_fails_in_the_middle(spark, tmp_path):
    src, at, check, schema = f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/check", "id long, v string"
    for n in range(4):
        spark.createDataFrame([(k % 7, f"{n}-{k}") for k in range(n * 3, n * 3 + 5)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    broken = {"left": 1}

    def sink(df, n):
        log.append(df, "id", at, n, ["v"])
        if n == 2 and broken["left"]:
            broken["left"] = 0
            raise RuntimeError("lost after the write, before the commit")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost after"):
        q.awaitTermination()
    first = log.read(spark, at, schema).count()
    log.append_stream(stream, "id", at, check, ["v"]).awaitTermination()
    ids = [x["id"] for x in log.read(spark, at, schema).collect()]
    assert len(ids) == len(set(ids)) == 7 and first <= 7


def test_append_once_and_arrays_in_parts(spark, tmp_path):
    at = f"{tmp_path}/log"
    rows = spark.createDataFrame([(1,), (2,), (2,)], "id long").distinct()
    assert [files.append_once(rows, "id", at, batch=b).count() for b in ("x", "x", "y")] == [2, 2, 0]
    import glob
    import json

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        files.write_json_array(spark.range(50).select("id", F.lit("é").alias("t")), f"{tmp_path}/a", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(glob.glob(f"{tmp_path}/a/part-*"))
    text = "".join(open(p).read() for p in parts)
    assert len(parts) > 1 and [x["id"] for x in json.loads(text)] == list(range(50))
    files.write_json_array(spark.range(0), f"{tmp_path}/b", "id")
    assert json.loads("".join(open(p).read() for p in glob.glob(f"{tmp_path}/b/part-*"))) == []
