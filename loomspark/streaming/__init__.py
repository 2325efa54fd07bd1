"""Structured Streaming counterparts of the polling loops.

State is kept per key and by event time: timers fire as the watermark passes them, so a replay
gives what the first run gave. Rows of a key that come in one micro-batch are put in order of time
before they are judged, whatever chunks they come in.

``feed`` and ``limited`` keep their state row by row, in maps and lists of a store that reads and writes
what a batch touches (RocksDB, which ``row_state`` sets for the session): a batch costs what its own
rows cost, however much a key has seen.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators.jobs import LEASE_SECONDS
from ..operators.workflows import Limits


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1, name: str = "*.parquet", schema: StructType | None = None) -> DataFrame:
    """Parquet files of a folder as they come, those whose name fits; without a schema, with that
    of the ones there now."""
    if schema is None:
        schema = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).option("recursiveFileLookup", True).parquet(folder)


def progress(events: DataFrame, key: str = "request_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """STM1, the pages alone: each finished page once, with a bounded memory of the keys seen."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def _after(state: GroupState, us: int) -> None:
    """Sets the timer, after the watermark as it must be."""
    state.setTimeoutTimestamp(max(us // 1000, state.getCurrentWatermarkMs() + 1))


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key in this micro-batch, by time (``us``, microseconds, which hang on no time
    zone); one frame, as chunks come in any order."""
    return pd.concat(list(frames), ignore_index=True).sort_values("us", kind="stable")


def _passed(state: GroupState, rows: list) -> tuple[list, list]:
    """Those of the rows (times, or lists that begin with them) that the watermark has passed, so
    that none can come before them any more, and those that wait; both in order of time."""
    time = lambda r: r[0] if isinstance(r, list) else r
    rows, passed = sorted(rows, key=time), state.getCurrentWatermarkMs() * 1000
    n = bisect_left(rows, passed, key=time)
    return rows[:n], rows[n:]


def row_state(spark: SparkSession) -> None:
    """State by row needs this store; queries that run, and their checkpoints, keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _struct(**fields: object) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


class _Timed(StatefulProcessor):
    """Keeps one timer a key, so that a later one replaces it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", _struct(ms=LongType()))

    def after(self, us: int, timers: object) -> None:
        """The key's timer: at this event time, after the watermark as it must be."""
        at = max(us // 1000, timers.getCurrentWatermarkInMs() + 1)
        if self.timer.exists():
            old = self.timer.get()[0]
            if old == at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


class _Feed(_Timed):
    """What has been sent of a job: a map of ids, asked and written one by one."""

    def __init__(self, keep_us: int) -> None:
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sent = handle.getMapState("sent", _struct(id=StringType()), _struct(yes=BooleanType()))
        self.phase = handle.getValueState("phase", _struct(done=BooleanType()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame, out = _in_order(rows), []
        known = self.phase.exists()
        done, at = known and self.phase.get()[0], int(frame["us"].max())
        if not done:
            fresh = [r for r in dict.fromkeys(frame["request_id"].dropna()) if not (known and self.sent.containsKey((r,)))]
            out = [("document", [r], at) for r in fresh] if known else [("catchup", fresh, at)]
            done = bool(frame["terminal"].any())
            if done:
                out.append(("done", [], at))
                self.sent.clear()
            else:
                for r in fresh:
                    self.sent.updateValue((r,), (True,))
            self.phase.update((done,))
        self.after(at + self.keep_us, timerValues)
        # Lists go as JSON, and texts as plain objects: the way out of the worker knows no others.
        texts = {"job_id": [key[0]] * len(out), "type": [o[0] for o in out], "ids": [json.dumps(o[1]) for o in out]}
        if out:
            yield pd.DataFrame({**{n: pd.Series(v, dtype=object) for n, v in texts.items()}, "at": [o[2] for o in out]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        for state in (self.sent, self.phase, self.timer):
            state.clear()
        return iter(())


def feed(events: DataFrame, key: str = "job_id", late: str = "10 minutes", keep_s: int = 3600) -> DataFrame:
    """STM1, the protocol: events (job_id, request_id or null, ts, terminal boolean) to messages
    (job_id, type, request_ids, at). What is there when a job is first seen comes as one
    ``catchup``; after that each page not sent yet is a ``document``; the row that ends a job gives
    ``done``, after which nothing follows. State of a job is a map of its sent ids, of which a batch
    touches those that it has, and none after ``done``; it goes ``keep_s`` of event time after the
    job's last row. Rows later than ``late`` go.
    """
    row_state(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("job_id"), F.col("request_id").cast("string").alias("request_id"), "ts", F.unix_micros("ts").alias("us"), F.coalesce("terminal", F.lit(False)).alias("terminal")).where("ts is not null").withWatermark("ts", late)
    out = rows.groupBy("job_id").transformWithStateInPandas(_Feed(keep_s * 1_000_000), "job_id string, type string, ids string, at bigint", "Append", "EventTime")
    return out.select("job_id", "type", F.from_json("ids", "array<string>").alias("request_ids"), F.timestamp_micros("at").alias("at"))


def windowed(events: DataFrame, key: str, ts: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of event-time windows, late rows beyond the watermark left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str, ts: str = "ts", gap_s: int = 1800, ttl_s: int = 14_400, late: str = "2 hours", early: bool = True) -> DataFrame:
    """STM5: (key, started_at, ended_at, reason, n): spans of activity. A session ends ``gap_s``
    after its last activity (``idle``) or ``ttl_s`` after its start (``ttl``), whichever is first; what
    comes at that moment or later starts another. Ended sessions come out once the watermark has
    passed their end, or with the rows that show it; those rows may be overtaken by late ones.
    Without ``early``, rows wait for the watermark, so that late ones take their places and nothing
    hangs on how rows fall into batches: just what ended before the watermark comes out."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, kept = state.get if state.exists else (None, None, 0, "[]")
        gap, ttl, out = gap_s * 1_000_000, ttl_s * 1_000_000, []

        def end() -> int:
            return min(last + gap, start + ttl)

        def close() -> None:
            out.append((start, end(), "ttl" if start + ttl <= last + gap else "idle", n))

        if early and state.hasTimedOut:
            close()
            state.remove()
        else:
            came = [] if state.hasTimedOut else _in_order(frames)["us"].tolist()
            due, waiting = (came, []) if early else _passed(state, json.loads(kept) + came)
            for now in due:
                if start is not None and now >= end():
                    close()
                    start = None
                if start is None:
                    start, last, n = now, now, 0
                last, n = max(now, last), n + 1
            if not early and start is not None and end() // 1000 < state.getCurrentWatermarkMs():
                close()
                start = None
            if start is None and not waiting:
                state.remove()
            else:
                state.update((start, last, n, json.dumps(waiting)))
                _after(state, min(waiting[:1] + ([] if start is None else [end()])))
        yield pd.DataFrame({"key": [k[0]] * len(out), **{c: [o[i] for o in out] for i, c in enumerate(("started_at", "ended_at", "reason", "n"))}})

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us")).where("ts is not null").withWatermark("ts", late)
    out = rows.groupBy("key").applyInPandasWithState(fold, "key string, started_at bigint, ended_at bigint, reason string, n bigint", "start bigint, last bigint, n bigint, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "ended_at")})


class _Limited(_Timed):
    """When requests of a key were let in within the last minute: a list that never holds more than
    ``per_minute``."""

    def __init__(self, per_minute: int, idle_us: int) -> None:
        self.per_minute, self.idle_us = per_minute, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", _struct(us=LongType()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        limits = Limits(self.per_minute, 1 << 62, sorted(r[0] for r in self.recent.get()) if self.recent.exists() else ())
        times = _in_order(rows)["us"].tolist()
        ok = [limits.decide(t)[0] == "ok" for t in times]
        if limits.recent:
            self.recent.put([(t,) for t in limits.recent])
        elif self.recent.exists():
            self.recent.clear()
        self.after(times[-1] + self.idle_us, timerValues)
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(times), dtype=object), "ts": times, "allowed": ok})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        self.timer.clear()
        return iter(())


def limited(requests: DataFrame, per_minute: int, key: str = "key", ts: str = "ts", idle_s: int = 300, late: str = "10 minutes") -> DataFrame:
    """STM3: the sliding limiter with state: let in unless the key had ``per_minute`` let in within
    60 seconds; keys idle for ``idle_s`` of event time are forgotten, rows later than ``late`` go, as
    do rows without a time. A null key is a key like others."""
    row_state(requests.sparkSession)
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us")).where("ts is not null").withWatermark("ts", late)
    out = rows.groupBy("key").transformWithStateInPandas(_Limited(per_minute, idle_s * 1_000_000), "key string, ts bigint, allowed boolean", "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))


def task_timers(events: DataFrame, lease_s: int = LEASE_SECONDS, late: str = "10 minutes", ended_s: int = 3600, early: bool = True) -> DataFrame:
    """STM4: events (task_id, event, ts) to the timers that fire: (task_id, event, at, attempts).

    ``claimed`` gives a lease and counts an attempt, ``renewed`` prolongs it; a lease that runs out
    fires ``lease_expired``, and the task may be claimed again; before, a claim doesn't count. ``failed`` waits the delay of its
    attempts and then fires ``retry_due``. ``finished`` ends a task: what follows doesn't count. A
    timer that a later row of the batch overtakes fires before that row counts. A finished task is
    forgotten ``ended_s`` later; others stay, as their attempts count on. Without ``early``, rows wait
    for the watermark as in ``sessions``, and just the timers before it fire.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, until, attempts, kept = state.get if state.exists else ("queued", 0, 0, "[]")
        out, runs = [], ("active", "waiting")

        def fire() -> None:
            nonlocal phase
            out.append(({"active": "lease_expired", "waiting": "retry_due"}[phase], until, attempts))
            phase = "queued"

        came = []
        if not state.hasTimedOut:
            rows = _in_order(frames)
            came = [list(r) for r in zip(rows["us"].tolist(), rows["event"].tolist(), strict=True)]
        due, waiting = (came, []) if early else _passed(state, json.loads(kept) + came)
        for now, event in due:
            if phase in runs and now >= until:
                fire()
            if phase == "finished":
                continue
            if event == "claimed" and phase == "queued":
                phase, until, attempts = "active", now + lease_s * 1_000_000, attempts + 1
            elif event == "renewed" and phase == "active":
                until = now + lease_s * 1_000_000
            elif event == "failed" and phase == "active":
                phase, until = "waiting", now + 1_000_000 * min(300, 5 * 2 ** min(max(attempts - 1, 0), 6))
            elif event == "finished":
                phase, until = "finished", now + ended_s * 1_000_000
        passed = until // 1000 < state.getCurrentWatermarkMs()
        if phase in runs and passed and (state.hasTimedOut or not early):
            fire()
        if phase == "finished" and passed and state.hasTimedOut and not waiting:
            state.remove()
        else:
            state.update((phase, until, attempts, json.dumps(waiting)))
            if times := [r[0] for r in waiting[:1]] + ([] if phase == "queued" else [until]):
                _after(state, min(times))
        yield pd.DataFrame({"task_id": [k[0]] * len(out), **{c: [o[i] for o in out] for i, c in enumerate(("event", "at", "attempts"))}})

    rows = events.select(F.col("task_id").cast("string").alias("task_id"), "event", "ts", F.unix_micros("ts").alias("us")).where("ts is not null").withWatermark("ts", late)
    out = rows.groupBy("task_id").applyInPandasWithState(fold, "task_id string, event string, at bigint, attempts int", "phase string, until bigint, attempts int, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("at", F.timestamp_micros("at"))


def at_most_once(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], trigger: dict | None = None):
    """STM6: a batch loop whose ``write(batch, batch_id)`` must do nothing for an id that it has
    done; the checkpoint remembers how far the stream was read."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def worker(stream: DataFrame, checkpoint: str, folder: str, process: Callable[[DataFrame], DataFrame], trigger: dict | None = None):
    """STM2: claims what has come, processes it and keeps the result under the batch's own name in
    ``folder``; a batch that is tried again replaces its own result and no other. ``trigger``: how
    often to look, ``{"processingTime": "500 milliseconds"}`` for a loop without end."""
    return at_most_once(stream, checkpoint, lambda batch, i: process(batch).write.mode("overwrite").parquet(f"{folder}/batch={i}"), trigger)
