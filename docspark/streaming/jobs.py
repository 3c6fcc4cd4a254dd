"""Structured Streaming forms of the history operators.

The stateful ones run on transformWithState (state store: RocksDB, see `stateful`): a key's rows lie in a list state until the watermark
has passed them and are then taken in order of time, so that the outcome does not hang on how rows fall into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docspark.operators.history import Burst, fold, near_place

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """The session, set up for the stateful streams (call it before they start)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def job_progress_stream(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Steps and last time of each job and window; events later than the watermark are dropped."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "job_id").agg(F.count("*").alias("steps"), F.max("ts").alias("last_ts"))


def checkpoint_stream(log: DataFrame, idle: str = "1 second", watermark: str = "10 minutes") -> DataFrame:
    """One row for each burst of changes of a session, closed after `idle` without a change."""
    return log.withWatermark("ts", watermark).groupBy("session_id", F.session_window("ts", idle).alias("burst")).agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


class InOrder(StatefulProcessor):
    """Rows of a key in order of time: they wait in a list state until the watermark passes them, then `settle` gets them sorted.

    fields: their state's schema, beginning with at (microseconds) and event_id. One timer a key is set, to the earliest row that
    waits or to the time that settle asks for.
    """

    def __init__(self, fields: str):
        self.fields = fields
        self.columns = [f.strip().split(" ")[0] for f in fields.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.timer = handle.getValueState("timer", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Opens the states of a key beside the waiting rows."""

    def settle(self, key, rows: list[tuple], now: int) -> tuple[pd.DataFrame, int | None]:
        """What the rows up to now (microseconds) give, and when to call again if no row comes until then."""
        raise NotImplementedError

    def _set_timer(self, at: int | None) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if at is not None:
            ms = max(1, -(-at // 1000))
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                self.waiting.appendList([tuple(v.item() if hasattr(v, "item") else v for v in r) for r in frame[self.columns].itertuples(index=False, name=None)])
                first = min(first, int(frame["at"].min())) if first is not None else int(frame["at"].min())
        if first is not None and (not self.timer.exists() or self.timer.get()[0] * 1000 > first):
            self._set_timer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        ready, later = [], []
        for row in self.waiting.get():
            (ready if row[0] <= now else later).append(tuple(row))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        out, again = self.settle(key, sorted(ready, key=lambda r: r[:2]), now)
        times = [t for t in (again, min((r[0] for r in later), default=None)) if t is not None]
        self._set_timer(min(times) if times else None)
        if len(out):
            yield out


class Histories(InOrder):
    """A key's history as two list states, of past and of future states, and the present one."""

    def __init__(self, limit: int):
        super().__init__("at long, event_id long, action string, state long")
        self.limit = limit

    def open(self, handle):
        self.past, self.future, self.present = handle.getListState("past", "state long"), handle.getListState("future", "state long"), handle.getValueState("present", "state long")

    def settle(self, key, rows, now):
        if not rows:
            return pd.DataFrame(), None
        state = [r[0] for r in self.past.get()], self.present.get()[0] if self.present.exists() else None, [r[0] for r in self.future.get()]
        for _, _, action, value in rows:
            state = fold(*state, action, value, self.limit)
        past, present, future = state
        for kept, values in ((self.past, past), (self.future, future)):
            kept.put([(v,) for v in values]) if values else kept.clear()
        if present is not None:
            self.present.update((present,))
        return pd.DataFrame({"session_id": [key[0]], "present": [present], "n_past": [len(past)], "n_future": [len(future)]}).astype({"present": "Int64"}), None


def replay_history_stream(log: DataFrame, limit: int = 100, watermark: str = "10 minutes") -> DataFrame:
    """replay_history of each session up to the watermark, a row whenever that takes in new rows: session_id, present, n_past, n_future.

    The state holds at most limit past states and the rows that the watermark has not passed; rows later than it are dropped.
    """
    rows = log.withWatermark("ts", watermark).where("session_id is not null").select("session_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "action", "state")
    return rows.groupBy("session_id").transformWithStateInPandas(Histories(limit), "session_id long, present long, n_past long, n_future long", "Update", "EventTime")


class Visits(InOrder):
    """The last places of a key as a list state; a place is appended, the list rewritten only when it is full."""

    def __init__(self, limit: int, near: float):
        super().__init__("at long, event_id long, page string, zoom double, y double")
        self.limit, self.near = limit, near

    def open(self, handle):
        self.places = handle.getListState("places", "page string, zoom double, y double")

    def settle(self, key, rows, now):
        places = [tuple(p) for p in self.places.get()]
        fresh = []
        for _, _, *place in rows:
            last = fresh[-1] if fresh else places[-1] if places else None
            if last is None or not near_place(last, place, self.near):
                fresh.append(tuple(place))
        if not rows:
            return pd.DataFrame(), None
        if len(places) + len(fresh) > self.limit:
            self.places.put((places + fresh)[-self.limit :])
        elif fresh:
            self.places.appendList(fresh)
        places = (places + fresh)[-self.limit :]
        return pd.DataFrame({"session_id": [key[0]], "page": [places[-1][0]], "y": [places[-1][2]], "n_back": [len(places)]}), None


def reading_history_stream(visits: DataFrame, limit: int = 100, near: float = 0.5, watermark: str = "10 minutes") -> DataFrame:
    """The reading history of each session up to the watermark: session_id, page, y (the latest place) and n_back.

    visits: session_id, ts, event_id, page, zoom, y. A visit to the place before it (same page and zoom, y less than `near`
    away) adds nothing; the state holds the last `limit` places and the rows that the watermark has not passed.
    """
    kinds = [F.col("zoom").cast("double").alias("zoom"), F.col("y").cast("double").alias("y")]
    rows = visits.withWatermark("ts", watermark).where("session_id is not null").select("session_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "page", *kinds)
    return rows.groupBy("session_id").transformWithStateInPandas(Visits(limit, near), "session_id long, page string, y double, n_back long", "Update", "EventTime")


class Checkpoints(InOrder):
    """A key's open burst; it is written when the watermark passes its idle time or its deadline, with or without further rows."""

    def __init__(self, idle: float, deadline: float):
        super().__init__("at long, event_id long")
        self.idle, self.deadline = idle, deadline

    def open(self, handle):
        self.burst = handle.getValueState("burst", "first long, last long, changes long")

    def settle(self, key, rows, now):
        burst = Burst(self.idle, self.deadline, *(self.burst.get() if self.burst.exists() else ()))
        done = [d for at, _ in rows for d in burst.add(at)] + burst.expire(now)
        self.burst.update((burst.first, burst.last, burst.changes)) if burst.changes else self.burst.clear()
        stamp = lambda k: pd.to_datetime([d[k] for d in done], unit="us", utc=True)
        out = pd.DataFrame({"session_id": [key[0]] * len(done), "first_ts": stamp(0), "last_ts": stamp(1), "changes": [d[2] for d in done]})
        return out, burst.due()


def checkpoint_deadline_stream(log: DataFrame, idle_seconds: float = 1.0, deadline_seconds: float = 5.0, watermark: str = "10 minutes") -> DataFrame:
    """checkpoint_coalesce with a deadline, as a stream: session_id, first_ts, last_ts, changes of each checkpoint, written as soon as the
    watermark has passed the idle time after its last change or the deadline after its first one. Later rows are dropped."""
    rows = log.withWatermark("ts", watermark).where("session_id is not null").select("session_id", "ts", F.unix_micros("ts").alias("at"), "event_id")
    return rows.groupBy("session_id").transformWithStateInPandas(Checkpoints(idle_seconds, deadline_seconds), "session_id long, first_ts timestamp, last_ts timestamp, changes long", "Append", "EventTime")
