"""Live runs: stalls, progress, tailed files and captured cases; ``live`` has the streams that keep state of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

FIELDS = ["size", "mtime", "n_files"]
KINDS = ["finished", "failed", "cancelled", "awaiting_approval"]


def stall_batch(heartbeats: DataFrame, timeout_sec: float) -> DataFrame:
    """Seconds since a run's heartbeat last changed, at each heartbeat; the first counts as a change.

    The batch twin of ``live.stall_stream``. A timeout of 0 never stalls.
    """
    w = Window.partitionBy("run_id").orderBy("ts", *FIELDS)
    changed = F.lit(False)
    for f in FIELDS:
        changed = changed | ~F.col(f).eqNullSafe(F.lag(f).over(w))
    first = F.row_number().over(w) == 1
    marked = heartbeats.withColumn("since", F.when(first | changed, F.col("ts")))
    last = F.max("since").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    idle = F.greatest(F.lit(0.0), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1e6)
    return marked.select("run_id", "ts", idle.alias("idle_sec")).withColumn("stalled", (F.lit(timeout_sec) > 0) & (F.col("idle_sec") >= timeout_sec))


def latest_tasks(rows: DataFrame) -> DataFrame:
    """The last row of each task of a run, the greatest of several at one time."""
    last = F.max_by(F.struct("status", "exit_code", "ts"), F.struct("ts", "status", "exit_code"))
    return rows.groupBy("run_id", "task_id").agg(last.alias("r")).select("run_id", "task_id", "r.*")


def task_done(status: Column) -> Column:
    return F.coalesce(F.upper(status).isin("COMPLETED", "CACHED", "FAILED", "ABORTED"), F.lit(False))


def progress(rows: DataFrame) -> DataFrame:
    """Submitted, completed, running and failed tasks of each run and its elapsed seconds, from rows that may repeat tasks."""
    t = latest_tasks(rows)
    done = task_done(F.col("status"))
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return t.groupBy("run_id").agg(
        F.count("*").alias("submitted"), F.count_if(done).alias("completed"), F.count_if(~done).alias("running"), F.count_if(S.task_failed(F.col("status"), F.col("exit_code"))).alias("failed"), span.alias("elapsed_sec")
    )


def json_tail(spark: SparkSession, path: str, schema: str, required: str) -> DataFrame:
    """A stream of JSON lines; half-written and invalid lines are left out."""
    raw = spark.readStream.text(path)
    parsed = raw.select(F.from_json("value", schema).alias("r")).select("r.*")
    return parsed.where(F.col(required).isNotNull())


def status_feed(events: DataFrame) -> DataFrame:
    """Lifecycle events of the known kinds; batch or stream."""
    return events.where(F.col("kind").isin(KINDS)).select("ts", "run_id", "kind", "message")


def capture(finished: DataFrame, target: str, checkpoint: str):
    """Append each finished bad run once to the pending cases; a run that a restart sends again is not written twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        bad = batch.where(F.col("verdict").isin("fail", "warn")).select("run_id", "verdict").dropDuplicates(["run_id"])
        try:
            known = spark.read.schema("run_id string, verdict string").parquet(target)
            bad = bad.join(known.select("run_id"), "run_id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        bad.write.mode("append").parquet(target)

    return finished.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
