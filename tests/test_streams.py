"""Streams against their batch forms, over restarts from a checkpoint, with late and shuffled rows."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import history
from docspark.streaming import jobs

START = 1_700_000_000


def feed(spark, tmp_path, parts, columns, make, name, mode):
    """Runs the stream anew for each part, from one checkpoint; then one row a day later carries the watermark on. All rows that came out."""
    jobs.stateful(spark)
    out = []
    schema = spark.createDataFrame([], columns).withColumn("ts", F.timestamp_micros("at")).drop("at").schema
    for k, part in enumerate([*parts, [(0, 10**6 * (START + 200_000), 0, *["x" if "string" in c else 0.0 if "double" in c else 0 for c in columns.split(", ")[3:]])]]):
        spark.createDataFrame(part, columns).withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        table = f"{name}_{k}"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        kept = []
        q = make(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: kept.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None, table
        out += kept
    return out


def sessions(rng, n, columns):
    rows = []
    for i in range(n):
        at = 10**6 * START + i * 700_000 + rng.randrange(500_000)
        rows.append((rng.randint(1, 4), at, i, *[c(rng, i) for c in columns]))
    return rows


def in_parts(rng, rows, parts, spread):
    """Parts in order of time in which neighbouring rows have changed places."""
    rows = sorted(rows, key=lambda r: r[1] + rng.randrange(spread))
    size = -(-len(rows) // parts)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def test_history_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = sessions(rng, 260, [lambda r, i: r.choice(["commit", "commit", "undo", "redo"]), lambda r, i: i])
    late = [(1, 10**6 * (START - 5000), 999, "commit", 999)]
    columns = "session_id long, at long, event_id long, action string, state long"
    parts = in_parts(rng, rows, 3, 4_000_000)
    parts[-1] = parts[-1] + late
    out = feed(spark, tmp_path, parts, columns, lambda s: jobs.replay_history_stream(s, 7, "10 seconds"), "hist", "update")
    latest = {}
    for r in out:
        latest[r[0]] = r
    want = history.replay_history(spark.createDataFrame(rows, columns).withColumn("ts", F.timestamp_micros("at")), 7).collect()
    assert {k: v for k, v in latest.items() if k} == {r.session_id: tuple(r) for r in want}
    assert len(out) > len(latest)  # it came out part by part


def test_visits_equal_a_fold(spark, tmp_path):
    rng = random.Random(2)
    rows = sessions(rng, 200, [lambda r, i: r.choice("ab"), lambda r, i: r.choice([1.0, 2.0]), lambda r, i: r.choice([0.0, 0.3, 5.0])])
    columns = "session_id long, at long, event_id long, page string, zoom double, y double"
    out = feed(spark, tmp_path, in_parts(rng, rows, 3, 3_000_000), columns, lambda s: jobs.reading_history_stream(s, 5, 0.5, "10 seconds"), "visits", "update")
    want = {}
    for session, _, _, *place in sorted(rows, key=lambda r: r[1:3]):
        places = want.setdefault(session, [])
        if not places or not history.near_place(places[-1], place, 0.5):
            places.append(place)
            del places[:-5]
    assert {r[0]: r[1:] for r in out if r[0]} == {k: (p[-1][0], p[-1][2], len(p)) for k, p in want.items()}


def test_checkpoints_at_idle_time_and_deadline(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, 10**6 * START + k * 400_000, k) for k in range(60)]  # one long burst
    rows += [(2, 10**6 * START + k * 1_500_000, 100 + k) for k in range(20)]  # each change alone
    rows += [(3, 10**6 * START + rng.randrange(40_000_000), 200 + k) for k in range(80)]
    columns = "session_id long, at long, event_id long"
    late = [(2, 10**6 * (START - 900), 999)]
    parts = in_parts(rng, rows, 3, 2_000_000)
    parts[-1] = parts[-1] + late
    out = feed(spark, tmp_path, parts, columns, lambda s: jobs.checkpoint_deadline_stream(s, 1, 5, "5 seconds"), "points", "append")
    want = history.checkpoint_coalesce(spark.createDataFrame(rows, columns).withColumn("ts", F.timestamp_micros("at")), 1, 5).collect()
    assert sorted(r for r in out if r[0]) == sorted(map(tuple, want))
    long = sorted(r for r in out if r[0] == 1)
    assert [r[3] for r in long[:-1]] == [13, 13, 13, 13] and long[-1][3] == 8  # 13 changes in five seconds, then the next one begins a new burst


def test_idle_bursts_and_job_progress(spark, tmp_path):
    rows = [(1, 10**6 * START + k * 600_000, k) for k in range(5)] + [(1, 10**6 * (START + 60), 9), (2, 10**6 * START, 10)]
    out = feed(spark, tmp_path, [rows], "session_id long, at long, event_id long", lambda s: jobs.checkpoint_stream(s, "1 second", "5 seconds").select("session_id", "changes"), "bursts", "append")
    assert sorted(r for r in out if r[0]) == [(1, 1), (1, 5), (2, 1)]
    jobs_in = [(j, 10**6 * START + k * 10**6, k) for j in (1, 2) for k in range(3 + j)]
    late = [(1, 10**6 * (START - 3 * 86_400), 99)]
    make = lambda s: jobs.job_progress_stream(s.withColumnRenamed("session_id", "job_id"), "10 minutes").select("job_id", "steps")
    out = feed(spark, tmp_path / "jobs", [jobs_in, late], "session_id long, at long, event_id long", make, "progress", "update")
    assert [r for r in sorted(out) if r[0]] == [(1, 4), (2, 5)]


@pytest.mark.parametrize("idle,deadline,times,want", [(1, 5, [0, 1, 2, 3, 4, 5, 6], [(0, 4, 5), (5, 6, 2)]), (1, 5, [0, 2, 3, 9], [(0, 0, 1), (2, 3, 2), (9, 9, 1)]), (10, 5, [0, 4, 8, 9, 13, 14], [(0, 4, 2), (8, 9, 2), (13, 14, 2)]), (1, None, [0, 1, 2, 4], [(0, 2, 3), (4, 4, 1)])])
def test_deadline_begins_with_the_first_change_after_a_checkpoint(idle, deadline, times, want):
    burst = history.Burst(idle, deadline)
    done = [d for t in times for d in burst.add(t * 10**6)]
    done += [(burst.first, burst.last, burst.changes)]
    assert [(a // 10**6, b // 10**6, n) for a, b, n in done] == want
