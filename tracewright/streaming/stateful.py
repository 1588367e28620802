"""Structured Streaming forms of the stateful operators. The state of a key is a few numbers and has a timer where silence matters."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tracewright.operators.gates import AgentState


def tail(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """S3: a folder to which JSON files are added, one for each rotation."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def run(stream: DataFrame, path: str) -> DataFrame:
    """Work off what is there, exactly once, into Parquet files and read them."""
    with rocks_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in here keep their state in RocksDB, on disk, which processors with timers and lists need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _in_order(parts: Iterator[pd.DataFrame], order: list[str], *more: str) -> list[list]:
    """The columns of a key's rows in a micro-batch, in order. Of the bounded batches only these columns stay, as arrays."""
    held = [[p[c].to_numpy() for c in (*order, *more)] for p in parts]
    columns = [np.concatenate(c) for c in zip(*held)]
    place = np.lexsort(columns[len(order) - 1 :: -1])
    return [c[place].tolist() for c in columns]


#: Buckets that the keys of anchored_windows are dealt to.
KEY_BUCKETS = 1024


def anchored_windows(events: DataFrame, key: str, time: str, width: int, idle_ms: int | None = None, idle: int | None = None, delay: str = "0 seconds", closing: str | None = None) -> DataFrame:
    """(key, window_start, n) of each closed window.

    W3: after idle_ms of wall time without an event, or idle microseconds of event time by which the watermark (delay behind
    the newest event) has passed a key, a timer hands its open window on. W4: a row whose closing column holds says that
    its key departs at that time; the window that is open then is handed on, and the row itself does not count.

    A micro-batch is put in order within a key; what comes in a later batch with an earlier time counts in the window
    that is open. After a silence of idle the next event opens a window at its own time, whether a timer came first or
    not, so windows do not depend on where micro-batches end. Keys are dealt to KEY_BUCKETS by hash: a bucket's state has
    (key, anchor, n, time of the last event, when it is due) of each open window, and its timer is that of the first due, so
    that very many keys do not cost a call into Python each.
    """
    kind = _kind(events, key)
    events = events.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS))).withColumn(key, F.col(key).cast("string"))
    if idle:
        events = events.withColumn("_at", F.timestamp_micros(time)).withWatermark("_at", delay)
    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows = {k: w for k, *w in zip(*state.get)} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if idle_ms else state.getCurrentWatermarkMs() if idle else 0
        out, seen = [], set()
        if not state.hasTimedOut:
            times, keys, *departs = _in_order(parts, [time], key, *([closing] if closing else []))
            for t, k, gone in zip(times, keys, departs[0] if closing else [False] * len(times)):
                anchor, n, last, _ = windows.get(k, (None, 0, None, 0))
                if anchor is None or t - anchor >= 2 * width or idle and t - last >= idle:
                    nxt = t
                else:
                    nxt = anchor + width if t - anchor >= width else anchor
                if n and (gone or nxt != anchor):
                    out.append((k, anchor, n))
                    n = 0
                if gone:
                    windows.pop(k, None)
                else:
                    last = t if last is None else max(last, t)
                    windows[k] = (nxt, n + 1, last, now + idle_ms if idle_ms else (last + idle) // 1000 if idle else 0)
                seen.add(k)
        if idle_ms or idle:
            for k in [k for k, w in windows.items() if w[3] < now and k not in seen]:
                anchor, n, *_ = windows.pop(k)
                out.append((k, anchor, n))
        if windows:
            state.update((list(windows), *map(list, zip(*windows.values()))))
            first = min(w[3] for w in windows.values())
            if idle_ms:
                state.setTimeoutDuration(max(first - now, 1))
            elif idle:
                state.setTimeoutTimestamp(max(first, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[key, "window_start", "n"])

    mode = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    held = f"`{key}` array<string>, anchor array<long>, n array<long>, last array<long>, due array<long>"
    rows = events.groupBy("_bucket").applyInPandasWithState(step, f"`{key}` string, window_start long, n long", held, "append", mode)
    return rows.withColumn(key, F.col(key).cast(kind))


def cooldown(alerts: DataFrame, key: str, time: str, quiet: int) -> DataFrame:
    """Alerts that are sent; the state is the time of the last one."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,), out = state.get if state.exists else (None,), []
        for t in sorted(int(t) for p in parts for t in p[time]):
            if last is None or t - last >= quiet:
                last = t
                out.append((k[0], t))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, time])

    return alerts.groupBy(key).applyInPandasWithState(step, f"`{key}` {_kind(alerts, key)}, `{time}` long", "last long", "append", GroupStateTimeout.NoTimeout)


def run_length(rows: DataFrame, key: str, time: str, tie: str, flag: str) -> DataFrame:
    """(key, tie, run): how many rows in a row, up to this one, are flagged; the state is that number."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run,) = state.get if state.exists else (0,)
        out = []
        for _, i, f in zip(*_in_order(parts, [time, tie], flag)):
            run = run + 1 if f else 0
            out.append((k[0], int(i), run))
        state.update((run,))
        yield pd.DataFrame(out, columns=[key, tie, "run"])

    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {_kind(rows, key)}, `{tie}` long, run long", "run long", "append", GroupStateTimeout.NoTimeout)


def sequence_rule(events: DataFrame, within: int, privilege: list[str], consume: list[str]) -> DataFrame:
    """G11 for events (pod, us, event_id, syscall): (event_id, pod, first_us); the state is the last exec."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,), out = state.get if state.exists else (None,), []
        for t, i, call in zip(*_in_order(parts, ["us", "event_id"], "syscall")):
            if call in privilege and last is not None and t - last <= within:
                out.append((i, k[0], last))
            if call == "execve":
                last = int(t)
            elif call in consume:
                last = None
        state.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "pod", "first_us"]).astype("int64")

    return events.groupBy("pod").applyInPandasWithState(step, "event_id long, pod long, first_us long", "last long", "append", GroupStateTimeout.NoTimeout)


class _Agents(StatefulProcessor):
    """What is remembered of an agent: its last scores as a list, and (pending, time of the last alert)."""

    def __init__(self, names: tuple[str, str, str, str], settings: dict, ttl_ms: int | None):
        self.names, self.settings, self.ttl = names, settings, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scores = handle.getListState("scores", "score double", self.ttl)
        self.counts = handle.getValueState("counts", "pending long, last double", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, time, tie, score = self.names
        agent = AgentState(**self.settings)
        if self.counts.exists():
            agent.remember([s for (s,) in self.scores.get()])
            agent.pending, agent.last = self.counts.get()
        out = [(key[0], i, *agent.step(float(s), float(t))) for t, i, s in zip(*_in_order(rows, [time, tie], score))]
        self.scores.put([(s,) for s in agent.scores]) if agent.scores else self.scores.clear()
        self.counts.update((agent.pending, agent.last))
        yield pd.DataFrame(out, columns=[name, tie, "decision", "limit_now"])

    def close(self) -> None:
        pass


def agent_decisions(rows: DataFrame, key: str, time: str, tie: str, score: str, ttl_ms: int | None = None, **options: float) -> DataFrame:
    """The same steps as the batch form. An agent that is not heard of for ttl_ms of wall time is forgotten."""
    settings = {"minimum": 0.5, "need": 2, "quiet": 3.0, "cap": 120, "ready": 10} | options
    kind = f"`{key}` {_kind(rows, key)}, `{tie}` long, decision string, limit_now double"
    return rows.groupBy(key).transformWithStateInPandas(_Agents((key, time, tie, score), settings, ttl_ms), kind, "append", "ProcessingTime" if ttl_ms else "None")


class _Late(StatefulProcessor):
    """The newest time of a key, and how many of its rows came behind it."""

    def __init__(self, names: tuple[str, str, str, str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "t long, n_late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        name, time, arrival, tie = self.names
        newest, n = self.newest.get() if self.newest.exists() else (None, 0)
        out = []
        for a, i, t in zip(*_in_order(rows, [arrival, tie], time)):
            late = newest is not None and t <= newest
            n += late
            newest = t if newest is None else max(newest, t)
            out.append((key[0], i, t, late, n))
        self.newest.update((newest, n))
        yield pd.DataFrame(out, columns=[name, tie, time, "late", "n_late"])

    def close(self) -> None:
        pass


def mark_late(rows: DataFrame, key: str, time: str, arrival: str, tie: str) -> DataFrame:
    """(key, tie, time, late, n_late) of every row, in the order of arrival: whether its time is not after all that its
    key had before, and how many such rows the key has had so far. No row is dropped: late ones are a side output."""
    kind = f"`{key}` {_kind(rows, key)}, `{tie}` long, `{time}` long, late boolean, n_late long"
    return rows.groupBy(key).transformWithStateInPandas(_Late((key, time, arrival, tie)), kind, "append", "None")


def late_by_key(marked: DataFrame, key: str, time: str) -> DataFrame:
    """Rows, late rows and the newest time of each key, of the rows of mark_late()."""
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("late").cast("long")).alias("n_late"), F.max(time).alias("newest"))


def deduplicated(rows: DataFrame, key: list[str], at: Column, delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return rows.withColumn("_at", at).withWatermark("_at", delay).dropDuplicatesWithinWatermark(key).drop("_at")


def sliding_counts(rows: DataFrame, key: list[str], at: Column, length: str, slide: str, delay: str) -> DataFrame:
    """(key, start_s, n) of sliding windows that the watermark has passed; late rows are dropped and counted by Spark's metrics."""
    w = rows.withColumn("_at", at).withWatermark("_at", delay).groupBy(*key, F.window("_at", length, slide).alias("_w")).agg(F.count("*").alias("n"))
    return w.select(*key, F.unix_seconds("_w.start").alias("start_s"), "n")


def write_decisions(rows: DataFrame, alert: str, decisions_path: str, alerts_path: str, checkpoint: str) -> None:
    """Every decision to one sink, alerts to another. A batch that is tried again overwrites its own folder."""

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{decisions_path}/batch={batch_id}")
        batch.filter(alert).write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")

    rows.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
