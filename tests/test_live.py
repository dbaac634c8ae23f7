"""Streams with state against their batch twins: retries, late rows, restarts, expiry."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.streaming import live, streams

rnd = random.Random(9)
TASKS = "run_id string, task_id long, ts timestamp_ltz, status string, exit_code int"


def parts_of(spark, rows, schema, n):
    """Rows shuffled into n parts."""
    rows = rnd.sample(rows, len(rows))
    return [spark.createDataFrame([(r[0], *r[1:]) for r in rows[k::n]], schema) for k in range(n)]


def run(spark, tmp_path, parts, make):
    out = str(tmp_path / "out")
    live.replay(parts, str(tmp_path), make, lambda b, i: b.write.mode("append").parquet(out))
    return spark.read.parquet(out)


def stamp(spark, rows, schema):
    """Seconds as times of the session's zone."""
    df = spark.createDataFrame(rows, schema.replace("timestamp_ltz", "long"))
    return df.withColumn("ts", F.timestamp_seconds("ts"))


def test_progress_takes_back_what_a_task_was(spark, tmp_path):
    rows = []
    for run_id in ("a", "b", "c"):
        for task in range(40):
            t = rnd.randint(0, 5000)
            states = [("SUBMITTED", None), ("RUNNING", None), *rnd.choice([[("COMPLETED", 0)], [("FAILED", 137), ("RUNNING", None), ("COMPLETED", 0)], [("FAILED", 1)], [("FAILED", 1), ("SUBMITTED", None)], []])]
            for k, (status, code) in enumerate(states):
                rows += [(run_id, task, t + 60 * k, status, code)] * rnd.choice([1, 1, 2])
    rows += [("a", 3, 9999, None, None), (None, 1, 5, "FAILED", 1), ("a", None, 5, "FAILED", 1), ("b", 7, 9000, "RUNNING", None), ("b", 7, 9000, "COMPLETED", 0)]
    shuffled = rnd.sample(rows, len(rows))
    parts = [stamp(spark, shuffled[k::3], TASKS) for k in range(3)]
    got = run(spark, tmp_path, parts, lambda s: (live.progress_stream(s, expire_ms=None), "update"))
    last = got.groupBy("run_id").agg(F.max_by(F.struct("submitted", "completed", "running", "failed", "elapsed_sec"), "rows_seen").alias("r")).select("run_id", "r.*")
    df = stamp(spark, [r for r in rows if r[0] is not None and r[1] is not None], TASKS)
    span = df.groupBy("run_id").agg(((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("elapsed_sec"))
    want = streams.progress(df).drop("elapsed_sec").join(span, "run_id").select(last.columns)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert any(r.running for r in want.collect()) and got.count() > 3


def test_progress_forgets_quiet_runs(spark, tmp_path):
    parts = [stamp(spark, [("a", 1, 50, "FAILED", 1), ("z", 1, 10_000, "RUNNING", None)], TASKS), stamp(spark, [("a", 2, 10_100, "COMPLETED", 0)], TASKS)]
    got = run(spark, tmp_path, parts, lambda s: (live.progress_stream(s, "1 second", expire_ms=60_000), "update"))
    assert [(r.submitted, r.failed) for r in got.where("run_id = 'a'").orderBy("rows_seen", "failed").collect()] == [(1, 0), (1, 1)]


BEATS = "run_id string, ts timestamp_ltz, size long, mtime long, n_files long"


@pytest.mark.parametrize("timeout", [600, 0])
def test_stall_equals_batch_out_of_order(spark, tmp_path, timeout):
    rows = []
    for run_id in ("a", "b"):
        size = 0
        for t in sorted(rnd.sample(range(0, 9000), 60)):
            size += rnd.random() < 0.15
            rows.append((run_id, t, size, 1, 2))
    rows += [("a", rows[5][1], 99, 1, 2), ("a", rows[5][1], 98, 1, 2)]  # of one time
    arrival = sorted(rows, key=lambda r: r[1] + rnd.randint(0, 1500))
    cut = [arrival[:40], arrival[40:80], arrival[80:], [("z", 50_000, 0, 0, 0)]]
    got = run(spark, tmp_path, [stamp(spark, c, BEATS) for c in cut], lambda s: (live.stall_stream(s, timeout, "3000 seconds"), "append"))
    want = streams.stall_batch(stamp(spark, rows, BEATS), timeout)
    assert sorted(map(tuple, got.where("run_id <> 'z'").collect())) == sorted(map(tuple, want.collect()))
    assert any(r.stalled for r in want.collect()) == (timeout > 0)


def test_stall_state_expires(spark, tmp_path):
    cut = [[("a", 50, 1, 1, 1), ("z", 1000, 0, 0, 0)], [("a", 1001, 1, 1, 1), ("z", 2000, 0, 0, 0)]]
    got = run(spark, tmp_path, [stamp(spark, c, BEATS) for c in cut], lambda s: (live.stall_stream(s, 600, "1 second", expire_ms=100_000), "append"))
    assert [r.idle_sec for r in got.where("run_id = 'a'").orderBy("ts").collect()] == [0.0, 0.0]
