"""Streams: demand with late data, sliding means, sessions, sequential alerts, timers."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wattloom.session import scratch


def read_events(spark: SparkSession, sf: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream of files.

    Without a limit availableNow takes all present files in one batch: part files need no
    order in time, as the watermark moves only after the batch. With a limit, rows behind
    the watermark of earlier files are late."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    e = reader.parquet(f"{sf}/events.parque*")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def demand(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """15-minute demand per series; a window is put out once the watermark is past it."""
    g = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "15 minutes").alias("w"))
    return g.agg(F.round(F.sum("value"), 2).alias("kw"), F.count("*").alias("n")).select(F.col("event_type").alias("series_id"), F.col("w.start").alias("ts15"), "kw", "n")


def sliding_mean(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 hour", "15 minutes").alias("w"))
    return g.agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("event_type").alias("series_id"), F.col("w.start").alias("ts15"), "mean", "n")


def sessions(events: DataFrame, gap: str, late: str = "30 minutes") -> DataFrame:
    """Bursts per user: a session ends after the gap."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def target_join(early: DataFrame, confirm: DataFrame, ahead: str = "45 minutes", late: str = "2 hours") -> DataFrame:
    """Early and confirming decisions on one target time: a watermarked stream-stream join."""
    a = early.withWatermark("ts15", late).select("series_id", (F.col("ts15") + F.expr(f"interval {ahead}")).alias("target"), F.col("kw").alias("early_kw"))
    b = confirm.withWatermark("ts15", late).select(F.col("series_id").alias("series"), F.col("ts15").alias("at"), F.col("kw").alias("confirm_kw"))
    return a.join(b, (F.col("series_id") == F.col("series")) & (F.col("target") == F.col("at"))).select("series_id", "target", "early_kw", "confirm_kw")


class InEventTime(StatefulProcessor):
    """Rows of a key, released one time after the other.

    A row waits in a list of the key, and a timer stands at the first waiting time. When the
    watermark has reached it, every row up to the watermark has come (later ones are late and
    left out), and all of them are released in the order of their times. Which batch brought
    a row, and in what order, changes nothing; what waits is bounded by the watermark's delay.
    A subclass has `columns`, the flags of a row that it uses, `schema`, the columns that it
    puts out, and released(), which works on `state`, a dictionary of its own of bounded size;
    state["due"] may hold times at which it wants to be called without rows. Times are
    milliseconds since 1970; rows of one time come in the order of their flags."""

    columns: tuple[str, ...] = ()
    schema: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time long, flags string")
        self.memory = handle.getValueState("memory", "state string")

    def released(self, key: tuple, time: int, rows: list[tuple[int, ...]], state: dict) -> list[tuple]:
        """What to put out at time; rows are the flags of the rows of that time."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        new = []
        for frame in rows:
            times = (frame["ts"] - pd.Timestamp(0)) // pd.Timedelta(1, "ms")
            new += [(time, " ".join(str(int(f)) for f in flags)) for time, *flags in zip(times.tolist(), *(frame[c].tolist() for c in self.columns)) if time > watermark]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0])
        yield pd.DataFrame([], columns=list(self.schema))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        state = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        rows, later = defaultdict(list), []
        for time, flags in self.waiting.get():
            if time <= watermark:
                rows[time].append(tuple(map(int, flags.split())))
            else:
                later.append((time, flags))
        out = []
        todo = [*rows, *(t for t in state.get("due", []) if t <= watermark)]
        heapq.heapify(todo)
        last = None
        while todo:
            time = heapq.heappop(todo)
            if time == last:
                continue
            before = set(state.get("due", []))
            out += self.released(key, time, sorted(rows.get(time, [])), state)
            for due in set(state.get("due", [])) - before:
                if due <= watermark:
                    heapq.heappush(todo, due)
            last = time
        if rows:
            self.waiting.put(later) if later else self.waiting.clear()
        if last is not None:
            state["due"] = [t for t in state.get("due", []) if t > watermark]
            self.memory.update((json.dumps(state),))
        if ahead := [t for t, _ in later] + state.get("due", []):
            self.handle.registerTimer(min(ahead))
        yield pd.DataFrame(out, columns=list(self.schema))

    def close(self) -> None:
        """The state store keeps everything."""


class SequentialAlert(InEventTime):
    """Watch at an early flag; at the target time, `horizon` later, the alert is settled.

    Rows are (series_id, ts, early, confirm) in any order within the watermark. A row in the
    last `confirm` before the target, or at it, confirms the alert by its flag, and that is put
    out at once; at the target it is rejected if such rows came without a flag, and expired if
    none came. The state holds the targets of the last horizon."""

    columns = ("early", "confirm")
    schema = ("series_id", "target", "state")

    def __init__(self, horizon_ms: int = 3_600_000, confirm_ms: int = 900_000):
        self.horizon, self.confirm = horizon_ms, confirm_ms

    def released(self, key, time, rows, state):
        watch, due, out = state.setdefault("watch", {}), state.setdefault("due", []), []
        put = lambda target, name: out.append((key[0], pd.Timestamp(int(target), unit="ms"), name))
        if rows:
            flag = any(confirm for _, confirm in rows)
            for target, name in watch.items():
                if time <= int(target) <= time + self.confirm and name != "confirmed":
                    watch[target] = "confirmed" if flag else "rejected"
                    if flag:
                        put(target, "confirmed")
        name = watch.pop(str(time), "confirmed")
        if name != "confirmed":
            put(time, "rejected" if name == "rejected" else "expired")
        if any(early for early, _ in rows):
            watch[str(time + self.horizon)] = "watch"
            due.append(time + self.horizon)
            put(time + self.horizon, "watch")
        return out


class DelayTimer(InEventTime):
    """k of the last m rows of a key, in the order of their times: a ring of m flags is the state."""

    columns = ("flag",)
    schema = ("series_id", "ts", "timer")

    def __init__(self, k: int = 2, m: int = 4):
        self.k, self.m = k, m

    def released(self, key, time, rows, state):
        ring, out = state.get("ring", ""), []
        for (flag,) in rows:
            ring = (ring + str(flag))[-self.m :]
            out.append((key[0], pd.Timestamp(time, unit="ms"), int(ring.count("1") >= self.k)))
        state["ring"] = ring
        return out


def stateful(rows: DataFrame, processor: InEventTime, schema: str, late: str = "30 minutes") -> DataFrame:
    """Run a processor keyed by series_id, with the state store that such processors need. What
    is put out has a time up to the watermark: the last `late` of a stream is still to come."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.withWatermark("ts", late).groupBy("series_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def run_now(stream: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Process what is there, in the shared folder, and give the written table."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return finish(spark.read.schema(stream.schema).parquet(f"{base}/out"))


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """Score each batch of a stream with a function of a batch, append it to the table at path
    under its batch number (a repeated batch replaces its own rows), and give the table."""

    def each(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out").drop("batch")
