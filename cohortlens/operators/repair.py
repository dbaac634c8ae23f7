"""Task events: costs, estimates, sizes for a retry, and the repair policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import REPAIRS


def cost(tasks: DataFrame, cpu_hour: float = 0.05, gb_hour: float = 0.005, keys: list[str] | None = None) -> DataFrame:
    """CPU and memory cost by run and process, with each run's total (process NULL) and the grand total."""
    keys = keys or ["run_id"]
    hours = F.col("realtime_sec") / 3600
    price = hours * F.col("pct_cpu") / 100 * cpu_hour + hours * F.col("peak_rss_mb") / 1024 * gb_hour
    return tasks.withColumn("cost", price).rollup(*keys, "process").agg(F.sum("cost").alias("cost"), F.count("*").alias("n_tasks"))


def estimate(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Runtime and memory for requests (request_id, pipeline, n_samples) from succeeded runs, else 600 s and 2048 MB a sample."""
    h = history.where((F.col("status") == "succeeded") & (F.col("n_samples") > 0)).groupBy("pipeline").agg(F.avg(F.col("runtime_sec") / F.col("n_samples")).alias("sec"), F.max("peak_mb").alias("mb"))
    out = requests.join(h, "pipeline", "left")
    return out.select(
        "request_id", "pipeline", (F.coalesce("sec", F.lit(600.0)) * F.col("n_samples")).alias("runtime_sec"), F.coalesce("mb", F.lit(2048.0) * F.col("n_samples")).alias("memory_mb"), F.when(F.col("sec").isNull(), "heuristic").otherwise("history").alias("basis")
    )


def size_retry(tasks: DataFrame, keys: list[str] | None = None, factor: float = 1.5) -> DataFrame:
    """Whole GB from the highest peak of processes that ran out of memory (exit 137), and hours from the longest task."""
    keys = keys or ["run_id"]
    oom = tasks.where(F.col("exit_code") == 137).select(*keys, "process").distinct()
    mem = tasks.join(oom, [*keys, "process"], "left_semi").groupBy(*keys).agg(F.max("peak_rss_mb").alias("mb"))
    time = tasks.groupBy(*keys).agg(F.max("realtime_sec").alias("sec"))
    return time.join(mem, keys, "left").select(*keys, F.ceil(F.col("mb") / 1024 * factor).alias("target_gb"), F.ceil(F.col("sec") / 3600 * factor).alias("target_h"))


def apply_ceiling(sized: DataFrame, keys: list[str] | None = None, ceiling_gb: int = 128, ceiling_h: int = 72, now_gb: int = 8, now_h: int = 4) -> DataFrame:
    """New limits: the size, else double, for time the larger of both, never above the ceiling nor below now."""
    keys = keys or ["run_id"]
    gb = F.greatest(F.least(F.coalesce("target_gb", F.lit(2 * now_gb)), F.lit(ceiling_gb)), F.lit(now_gb)).cast("long")
    h = F.greatest(F.least(F.greatest(F.coalesce("target_h", F.lit(0)), F.lit(2 * now_h)), F.lit(ceiling_h)), F.lit(now_h)).cast("long")
    return sized.select(*keys, gb.alias("memory_gb"), h.alias("time_h"))


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPAIRS, "failure_class string, kind string, operation string, risk string")


def repair_policy(diagnoses: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches for each diagnosis; classes without one make no row. Ambiguous below a confidence of 0.5."""
    return diagnoses.join(F.broadcast(patches), "failure_class").withColumn("ambiguous", F.col("confidence") < 0.5)


def repair_stats(steps: DataFrame) -> DataFrame:
    """Recovered and total runs by failure class; recovered: succeeded after some patch was applied."""
    run = steps.groupBy("run_id", "failure_class").agg(F.bool_or("patch_applied").alias("patched"), F.bool_or(F.col("outcome") == "succeeded").alias("ok"))
    return run.groupBy("failure_class").agg(F.count("*").alias("runs"), F.count_if(F.col("patched") & F.col("ok")).alias("recovered"))
