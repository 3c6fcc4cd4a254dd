"""Edit history, checkpoints, previews, jobs and stored blocks, in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micros(c):
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def fold(past: list, present, future: list, action: str, state, limit: int):
    """One step of a history of at most limit past states: a commit clears the future; undo and redo on nothing do nothing."""
    if action == "commit":
        return [*past, present][-limit:] if present is not None else past, state, []
    if action == "undo" and past:
        return past[:-1], past[-1], [present, *future]
    if action == "redo" and future:
        return [*past, present][-limit:], future[0], future[1:]
    return past, present, future


def near_place(last, place, near: float) -> bool:
    """Whether two places (page, zoom, y) are the same but for less than `near` of y."""
    return last[0] == place[0] and last[1] == place[1] and abs(last[2] - place[2]) < near


def replay_history(log: DataFrame, limit: int = 100) -> DataFrame:
    """(session_id, present, n_past, n_future) after the log (session_id, ts, event_id, action, state) in order.

    A session's rows come sorted and in batches; only the state of the history goes from batch to batch.
    """

    def run(batches):
        session, state = None, ([], None, [])
        for pdf in batches:
            done = []
            for r in pdf.itertuples(index=False):
                if r.session_id != session:
                    if session is not None:
                        done.append((session, state))
                    session, state = r.session_id, ([], None, [])
                state = fold(*state, r.action, r.state, limit)
            yield rows(done)
        if session is not None:
            yield rows([(session, state)])

    def rows(done):
        return pd.DataFrame([(i, present, len(past), len(future)) for i, (past, present, future) in done], columns=["session_id", "present", "n_past", "n_future"]).astype({"session_id": "int64", "present": "Int64", "n_past": "int64", "n_future": "int64"})

    ordered = log.where("session_id is not null").repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id").select("session_id", "action", "state")
    return ordered.mapInPandas(run, "session_id long, present long, n_past long, n_future long")


def bounded_history(states: DataFrame, limit: int = 100) -> DataFrame:
    """The newest states of each session, age 1 first."""
    by = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return states.withColumn("age", F.row_number().over(by).cast("long")).where(F.col("age") <= limit)


class Burst:
    """The changes that the next checkpoint will cover (times in microseconds): it is written when idle seconds pass without a
    change, or deadline seconds after the first change that it covers. The change after it begins the next one."""

    def __init__(self, idle: float, deadline: float | None, first: int = 0, last: int = 0, changes: int = 0):
        self.idle, self.deadline = round(idle * 1e6), None if deadline is None else round(deadline * 1e6)
        self.first, self.last, self.changes = first, last, changes

    def due(self) -> int | None:
        """When the checkpoint is written if no change comes; null without changes."""
        if not self.changes:
            return None
        return min(self.last + self.idle + 1, self.first + self.deadline) if self.deadline is not None else self.last + self.idle + 1

    def expire(self, now: int) -> list[tuple[int, int, int]]:
        """(first, last, changes) of the burst if it is due by now."""
        if not self.changes or self.due() > now:
            return []
        done, self.changes = (self.first, self.last, self.changes), 0
        return [done]

    def add(self, at: int) -> list[tuple[int, int, int]]:
        """Takes in a change not before the last one; gives the burst that was due by then."""
        done = self.expire(at)
        self.first, self.last, self.changes = self.first if self.changes else at, at, self.changes + 1
        return done


def checkpoint_coalesce(log: DataFrame, idle_seconds: float, deadline_seconds: float | None = None) -> DataFrame:
    """Bursts of changes of each session that one checkpoint covers (session_id, first_ts, last_ts, changes): a burst ends after more
    than idle_seconds without a change.

    With a deadline it also ends that long after its first change, and the next change begins a new one. Where a burst begins
    then depends on all before it, so each session's sorted rows go through a fold of three numbers.
    """
    log = log.where("session_id is not null")
    if deadline_seconds is not None:

        def run(batches):
            session, burst = None, Burst(idle_seconds, deadline_seconds)
            for pdf in batches:
                done = []
                for s, at in zip(pdf["session_id"].tolist(), pdf["at"].tolist()):
                    if s != session:
                        done += [(session, *d) for d in ([(burst.first, burst.last, burst.changes)] if burst.changes else [])]
                        session, burst = s, Burst(idle_seconds, deadline_seconds)
                    done += [(s, *d) for d in burst.add(at)]
                yield pd.DataFrame(done, columns=["session_id", "first", "last", "changes"])
            if burst.changes:
                yield pd.DataFrame([(session, burst.first, burst.last, burst.changes)], columns=["session_id", "first", "last", "changes"])

        ordered = log.select("session_id", micros("ts").alias("at")).where("at is not null").repartition("session_id").sortWithinPartitions("session_id", "at")
        kind = log.schema["ts"].dataType
        bursts = ordered.mapInPandas(run, f"session_id {log.schema['session_id'].dataType.simpleString()}, first long, last long, changes long")
        return bursts.select("session_id", F.timestamp_micros("first").cast(kind).alias("first_ts"), F.timestamp_micros("last").cast(kind).alias("last_ts"), "changes")
    by = Window.partitionBy("session_id").orderBy("ts", "event_id")
    new = F.coalesce(micros("ts") - micros(F.lag("ts").over(by)) > idle_seconds * 1e6, F.lit(True))
    g = log.withColumn("burst", F.sum(F.when(new, 1).otherwise(0)).over(by))
    return g.groupBy("session_id", "burst").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("changes")).drop("burst")


def preview_expiry(previews: DataFrame, now, ttl_seconds: int, max_items: int = 8, max_bytes: int = 64 << 20) -> DataFrame:
    """Previews (session_id, ts, event_id, bytes) still alive at `now` (Column), the newest max_items of each session while those newer
    take less than max_bytes, with seconds left."""
    age = (micros(now) - micros("ts")) / 1e6
    by = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))
    alive = previews.withColumn("left_s", ttl_seconds - age).where((F.col("left_s") > 0) & (age >= 0))
    newer = F.coalesce(F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return alive.withColumn("rank", F.row_number().over(by).cast("long")).withColumn("newer_bytes", newer).where((F.col("rank") <= max_items) & (F.col("newer_bytes") < max_bytes)).drop("newer_bytes")


def job_progress(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each job's completed and total steps, last stage and time, and whether its result may be shown: jobs has job_id and total; a
    job with the stage cancel shows no result, however far it came, and one of which steps are missing none either."""
    g = events.groupBy("job_id").agg(
        F.count(F.when(F.col("stage") != "cancel", 1)).alias("completed"), F.max_by("stage", F.struct("ts", "event_id")).alias("last_stage"), F.max("ts").alias("last_ts"), F.bool_or(F.col("stage") == "cancel").alias("cancelled")
    )
    j = jobs.select("job_id", "total").join(g, "job_id", "left")
    done = ~F.coalesce("cancelled", F.lit(False)) & (F.col("completed") >= F.col("total"))
    return j.select("job_id", F.coalesce("completed", F.lit(0)).alias("completed"), "total", "last_stage", "last_ts", F.coalesce(done, F.lit(False)).alias("has_result"))


def latest_valid_generation(checkpoints: DataFrame, payloads: DataFrame) -> DataFrame:
    """The newest generation of each store whose payloads (file, length, checksum) are all there with that length and checksum."""
    j = checkpoints.join(payloads.select("file", F.col("length").alias("real"), F.col("checksum").alias("real_sum")), "file", "left")
    fits = (F.col("real") == F.col("length")) & (F.col("real_sum") == F.col("checksum"))
    g = j.groupBy("store", "generation").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("ok"))
    return g.where("ok").groupBy("store").agg(F.max("generation").alias("generation"))


def retain_generations(generations: DataFrame, keep: int = 2) -> DataFrame:
    """Each generation with whether it is retained: the newest readable ones."""
    by = Window.partitionBy("store").orderBy(F.desc("readable"), F.desc("generation"))
    return generations.withColumn("retained", F.col("readable") & (F.row_number().over(by) <= keep))


def orphan_payloads(payloads: DataFrame, retained: DataFrame) -> DataFrame:
    return payloads.join(retained.select("file").distinct(), "file", "left_anti")


def block_dedup_report(versions: DataFrame, key: str, block: int = 65536, text: str = "text") -> DataFrame:
    """Blocks of so many bytes of the versions' texts (UTF-8) by content: digest, occurrences, bytes of one, versions that hold it, and
    the bytes that sharing saves."""
    data = versions.select(key, F.col(text).cast("binary").alias("_data")).where(F.length("_data") > 0)
    parts = data.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("_data"), F.lit(block)), lambda i: F.substring(F.col("_data"), i, F.lit(block)))).alias("b"))
    g = parts.select(key, F.sha2("b", 256).alias("digest"), F.length("b").cast("long").alias("bytes")).groupBy("digest").agg(F.count("*").alias("occurrences"), F.first("bytes").alias("bytes"), F.count_distinct(key).alias("versions"))
    return g.withColumn("saved_bytes", (F.col("occurrences") - 1) * F.col("bytes"))


def benchmark_summary(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, least, largest and 95th percentile of each group."""
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("median"), F.round(F.min(value), 6).alias("least"),
        F.round(F.max(value), 6).alias("largest"), F.round(F.percentile(value, 0.95), 6).alias("p95"),
    )


def benchmark_reduction(summary: DataFrame, fixture: str, version: str) -> DataFrame:
    """By how many percent each version's mean lies under the mean of the fixture's version before it (null for the first)."""
    before = F.lag("mean").over(Window.partitionBy(fixture).orderBy(version))
    return summary.select(fixture, version, F.round(100 * (1 - F.try_divide("mean", before)), 4).alias("reduction"))
