"""Streaming: conversation slots as keyed state, and event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.functions import tables

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SlotState(StatefulProcessor):
    """Folds the turns of a conversation, in the order of turns within a batch, into its slots; the state is one row: domain and slots."""

    def __init__(self, slots: list[str]):
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slots", T.StructType([T.StructField(n, T.StringType()) for n in ("domain", *self.slots)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = dict(zip(("domain", *self.slots), self.state.get(), strict=True)) if self.state.exists() else None
        out = []
        for r in sorted((r for b in rows for r in b.to_dict("records")), key=lambda r: r["turn"]):
            if now is None or now["domain"] != r["domain"]:
                now = {"domain": r["domain"], **dict.fromkeys(self.slots)}
            for s in self.slots:
                if r[s] is not None and not pd.isna(r[s]) and not (s in tables.STICKY_SLOTS and now[s] is not None):
                    now[s] = r[s]
            out.append({"session": key[0], "turn": r["turn"], **now})
        if now is not None:
            self.state.update(tuple(now[n] for n in ("domain", *self.slots)))
        yield pd.DataFrame(out, columns=["session", "turn", "domain", *self.slots])

    def close(self) -> None:
        pass


def slot_stream(turns: DataFrame, slots: list[str]) -> DataFrame:
    """A stream of turns (session, turn, domain, slots as text) with accumulated slots. Turns of a conversation must arrive in order."""
    schema = T.StructType([T.StructField("session", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("domain", T.StringType()), *[T.StructField(s, T.StringType()) for s in slots]])
    return turns.groupBy("session").transformWithStateInPandas(SlotState(slots), outputStructType=schema, outputMode="Append", timeMode="None")


class BreakerState(StatefulProcessor):
    """Counts a group's attempts and rejects; from the attempt on at which their ratio passes the limit, the group gives no more output, whatever comes later."""

    def __init__(self, most: float, warmup: int):
        self.most, self.warmup = most, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "attempts long, rejects long, stopped_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, bad, stopped = self.state.get() if self.state.exists() else (0, 0, None)
        for b in rows:  # sorted by attempt within a micro-batch, which may come in pieces
            if stopped is not None:
                break
            r = b["rejected"].astype("int64").cumsum() + bad
            k = pd.Series(range(n + 1, n + len(b) + 1), index=b.index)
            over = (k >= self.warmup) & (r / k > self.most)
            if over.any():
                b, k, r = (x.loc[: over.idxmax()] for x in (b, k, r))
                stopped = int(k.iloc[-1])
            n, bad = int(k.iloc[-1]), int(r.iloc[-1])
            last = pd.Series([stopped is not None and x == stopped for x in k], index=b.index)
            yield pd.DataFrame({"group": key[0], "attempt": b["attempt"], "rejected": b["rejected"], "n": k, "rejects": r, "stopped": last})
        self.state.update((n, bad, stopped))

    def close(self) -> None:
        pass


BREAKER = "group string, attempt long, rejected boolean, n long, rejects long, stopped boolean"


def breaker_stream(attempts: DataFrame, most: float = tables.MAX_REJECT_RATE, warmup: int = tables.REJECT_WARMUP) -> DataFrame:
    """BREAKER of a stream of attempts (group, attempt: a whole number, rejected): those until the group is stopped. Micro-batches must come in the order of attempts."""
    typed = attempts.select(F.col("group").cast("string").alias("group"), F.col("attempt").cast("long").alias("attempt"), F.coalesce("rejected", F.lit(False)).alias("rejected"))
    return typed.groupBy("group").transformWithStateInPandas(_Sorted(BreakerState(most, warmup), "attempt"), outputStructType=BREAKER, outputMode="Append", timeMode="None")


class _Sorted(StatefulProcessor):
    """A processor that gets a key's rows of a micro-batch in the order of a column."""

    def __init__(self, inner: StatefulProcessor, by: str):
        self.inner, self.by = inner, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = pd.concat(list(rows), ignore_index=True).sort_values(self.by, kind="stable", ignore_index=True)
        yield from self.inner.handleInputRows(key, iter([whole]), timerValues)

    def close(self) -> None:
        self.inner.close()


class SessionState(StatefulProcessor):
    """The registry of live sessions: when one was last heard of and how many messages it had. It is dropped once event time has passed `live` seconds without a message."""

    def __init__(self, live: int):
        self.live = live * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "first long, last long, messages long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = pd.concat([b["ts"] for b in rows]).astype("datetime64[ms]").astype("int64")
        old = self.state.get() if self.state.exists() else None
        first, last, n = (int(times.min()), int(times.max()), len(times)) if old is None else (min(old[0], int(times.min())), max(old[1], int(times.max())), old[2] + len(times))
        self.state.update((first, last, n))
        self._only(last + self.live)
        yield pd.DataFrame({"session": [key[0]], "event": ["opened" if old is None else "seen"], "messages": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.state.get()[2] if self.state.exists() else 0
        self.state.clear()
        yield pd.DataFrame({"session": [key[0]], "event": ["expired"], "messages": [n]})

    def _only(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def session_stream(messages: DataFrame, live: int, late: str = "0 seconds") -> DataFrame:
    """(session, event, messages) of a stream of messages (session, ts): sessions open, are seen again, and expire `live` seconds of event time after their last message."""
    typed = messages.select(F.col("session").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return typed.groupBy("session").transformWithStateInPandas(SessionState(live), outputStructType="session string, event string, messages long", outputMode="Append", timeMode="EventTime")


def live_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, first, last, messages) of the sessions that a query's state holds, read from its checkpoint."""
    state = spark.read.format("statestore").option("stateVarName", "session").load(checkpoint)
    return state.select(F.col("key.session").alias("session"), *[F.col(f"value.{c}").alias(c) for c in ("first", "last", "messages")])


class OpenTurn(StatefulProcessor):
    """A question stays open until all that its intent needs is known: its first missing slot is asked for, and the answer comes once nothing is missing."""

    def __init__(self, needed: dict[str, list[str]], questions: dict[str, str]):
        self.needed, self.questions = needed, questions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("open", "name string", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = {k[0]: v[0] for k, v in self.state.iterator()}
        out = []
        for b in rows:
            for r in b.to_dict("records"):
                if isinstance(r["intent"], str) and r["intent"] != known.get("_intent"):
                    known = {"_intent": r["intent"]}  # another question: what was said for the last one is dropped
                for name, value in (r["slots"] or {}).items():
                    if value is not None and known.get("_intent") is not None:
                        known[name] = value
                if known.get("_intent") is None:
                    continue
                missing = [n for n in self.needed.get(known["_intent"], []) if n not in known]
                said = self.questions.get(missing[0], f"Could you provide your {missing[0].replace('_', ' ')}?") if missing else None
                out.append((key[0], r["turn"], known["_intent"], "ASK" if missing else "ANSWER", said))
                if not missing:
                    known = {}  # answered: the turn is closed
        self.state.clear()
        for k, v in known.items():
            self.state.updateValue((k,), (v,))
        yield pd.DataFrame(out, columns=["session", "turn", "intent", "decision", "question"])

    def close(self) -> None:
        pass


OPEN = "session string, turn long, intent string, decision string, question string"


def ask_and_go_on(turns: DataFrame, needed: dict[str, list[str]], questions: dict[str, str]) -> DataFrame:
    """OPEN of a stream of turns (session, turn, intent: null where a turn only answers, slots: a string map): ASK with the question, as often as something is missing, then
    ANSWER. Turns before a session's first intent, and after an answer without a new intent, give nothing. Micro-batches must come in the order of turns."""
    typed = turns.select(F.col("session").cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), F.col("intent").cast("string").alias("intent"), F.col("slots").cast("map<string,string>").alias("slots"))
    return typed.groupBy("session").transformWithStateInPandas(_Sorted(OpenTurn(needed, questions), "turn"), outputStructType=OPEN, outputMode="Append", timeMode="None")


def run_once(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all that is there into Parquet with a checkpoint, both in the shared folder; returns what was written."""
    at = f"{folder}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None, key: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts and sums by tumbling (or sliding) windows of event time; `late` is a stream's watermark."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if late else e
    w: Column = F.window(ts, length, slide) if slide else F.window(ts, length)
    return e.groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None, key: str = "user_id", ts: str = "ts") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if late else e
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, late: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """A stream's events without repeats of the keys within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
