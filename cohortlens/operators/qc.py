"""Rule packs over metrics, cross-sample checks and verdicts. Every operator takes all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import RULE_SCHEMA, RULES, SEVERITY_OF
from .order import exact_median

BOUNDS = ["fail_below", "warn_below", "warn_above", "fail_above"]


def rules(spark: SparkSession, *packs: str) -> DataFrame:
    """Rule packs as a table of a few dozen rows; always small enough to broadcast."""
    rows = [(p, i, *r) for i, (p, *r) in enumerate(RULES) if not packs or p in packs]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _judged(df: DataFrame, keys: list[str]) -> DataFrame:
    value = F.col("value")
    status = F.when(S.unit_refused(F.col("unit"), value), "unverified").otherwise(S.band_status(value, *[F.col(b) for b in BOUNDS]))
    return df.select(
        *keys,
        F.concat_ws(":", "check", "sample").alias("check"),
        status.alias("status"),
        value.alias("value"),
        S.expected_range(*[F.col(b) for b in BOUNDS]).alias("expected_range"),
        S.band_less(*[F.col(b) for b in BOUNDS]).alias("informational"),
    )


def rule_eval(metrics: DataFrame, pack: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One check for each reported metric that a rule names; unreported metrics make no row."""
    keys = keys or ["run_id"]
    return _judged(metrics.join(F.broadcast(pack.drop("message")), "metric"), [*keys, "sample"])


def rule_eval_required(samples: DataFrame, metrics: DataFrame, pack: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One check for each sample and rule; unreported metrics are unverified with a NULL value.

    The rules (a few rows) are put beside each sample by an exploded constant, so nothing is joined for it.
    """
    keys = keys or ["run_id"]
    fields = ["check", "metric", *BOUNDS, "unit"]
    array = F.array(*[F.struct(*[F.lit(r[c]).cast("string" if c in ("check", "metric", "unit") else "double").alias(c) for c in fields]) for r in pack.collect()])
    wanted = samples.select(*keys, "sample").distinct().withColumn("r", F.explode(array)).select(*keys, "sample", "r.*")
    return _judged(wanted.join(metrics.select(*keys, "sample", "metric", "value"), [*keys, "sample", "metric"], "left"), [*keys, "sample"])


def severity(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in SEVERITY_OF.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def _named(rank: Column) -> Column:
    return F.when(rank == 3, "fail").when(rank == 2, "warn").when(rank == 1, "pass").otherwise("unverified")


def verdict(qc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Worst status of the checks that aren't informational; unverified without any."""
    keys = keys or ["run_id"]
    return qc.groupBy(*keys).agg(_named(F.max(F.when(~F.col("informational"), severity(F.col("status"))))).alias("verdict"))


def run_verdict(runs: DataFrame, qc: DataFrame, tasks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """fail if any task failed, else the verdict of the run's checks, unverified without checks."""
    keys = keys or ["run_id"]
    failed = tasks.groupBy(*keys).agg(F.bool_or(S.task_failed(F.col("status"), F.col("exit_code"))).alias("any_failed"))
    out = runs.select(*keys).join(failed, keys, "left").join(verdict(qc, keys), keys, "left")
    return out.select(*keys, F.when(F.coalesce("any_failed", F.lit(False)), "fail").otherwise(F.coalesce("verdict", F.lit("unverified"))).alias("verdict"))


def run_summary(tasks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    failed = F.count_if(S.task_failed(F.col("status"), F.col("exit_code")))
    return tasks.groupBy(*(keys or ["run_id"])).agg(F.count("*").alias("total"), failed.alias("failed"), (F.count("*") - failed).alias("succeeded"))


def library_skew(metrics: DataFrame, metric: str, keys: list[str] | None = None, warn: float = 3.0, fail: float = 10.0) -> DataFrame:
    """Largest over smallest value of a metric; runs of two samples or more. A least value of 0 fails, all 0 is unverified."""
    keys = keys or ["run_id"]
    of = metrics.where((F.col("metric") == metric) & F.col("value").isNotNull() & ~F.isnan("value"))
    a = of.groupBy(*keys).agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").alias("n")).where("n >= 2")
    ratio = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo"))
    status = F.when(F.col("hi") == 0, "unverified").when(F.col("lo") == 0, "fail").when(ratio >= fail, "fail").when(ratio >= warn, "warn").otherwise("pass")
    return a.select(*keys, F.lit("library_size_skew").alias("check"), status.alias("status"), ratio.alias("value"))


def min_samples(metrics: DataFrame, keys: list[str] | None = None, least: int = 2) -> DataFrame:
    """Distinct samples, read suffixes aside; fail below ``least``."""
    keys = keys or ["run_id"]
    n = F.count_distinct(F.regexp_replace("sample", " Read [0-9]+$", ""))
    return metrics.groupBy(*keys).agg(n.alias("n_samples")).select(*keys, "n_samples", F.when(F.col("n_samples") < least, "fail").otherwise("pass").alias("status"))


def mad_outliers(metrics: DataFrame, metric: str, keys: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Samples further than ``threshold`` median absolute deviations from the median; runs of three samples or more."""
    keys = keys or ["run_id"]
    of = metrics.where((F.col("metric") == metric) & F.col("value").isNotNull() & ~F.isnan("value"))
    mid = exact_median(of, "value", keys, "med").where("n_rows >= 3").drop("n_rows")
    dev = of.join(mid, keys).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    mad = exact_median(dev, "dev", keys, "mad").where("mad > 0").drop("n_rows")
    out = dev.join(mad, keys).withColumn("score", F.col("dev") / F.col("mad")).where(F.col("score") > threshold)
    return out.select(*keys, "sample", F.lit("warn").alias("status"), "value", "score")


def sorted_checks(qc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Checks by severity fail, warn, pass, unverified within each run, with their place."""
    keys = keys or ["run_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc(severity(F.col("status"))), "check")
    return qc.select(*keys, "check", "status", F.row_number().over(w).alias("place"))


def explain(qc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Verdict, how many checks decide it, the one of least value, and a sentence."""
    keys = keys or ["run_id"]
    judged = qc.where(~F.col("informational")).join(verdict(qc, keys), keys)
    decides = F.col("status") == F.col("verdict")
    a = judged.groupBy(*keys, "verdict").agg(
        F.count("*").alias("total"), F.count_if(decides).alias("deciding"), F.min(F.when(decides, F.struct(F.coalesce("value", F.lit(float("inf"))).alias("v"), F.col("check").alias("c")))).alias("m")
    )
    reason = F.format_string("%d of %d checks are %s", "deciding", "total", "verdict")
    return a.select(*keys, "verdict", "total", "deciding", F.col("m.c").alias("lowest"), reason.alias("reason"))


def list_runs(verdicts: DataFrame, contains: str = "", only: str | None = None, limit: int | None = None) -> DataFrame:
    """Runs whose id holds a text, worst verdict first (fail, warn, unverified, pass)."""
    order = F.when(F.col("verdict") == "fail", 0).when(F.col("verdict") == "warn", 1).when(F.col("verdict") == "unverified", 2).otherwise(3)
    out = verdicts.where(F.contains(F.lower("run_id"), F.lit(contains.lower())))
    out = (out.where(F.col("verdict") == only) if only else out).withColumn("sort_key", order)
    out = out.orderBy("sort_key", "run_id")
    return out.limit(limit) if limit else out


def qc_anomaly(runs: DataFrame, qc: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs that succeeded although their checks fail, with the failing checks as evidence."""
    keys = keys or ["run_id"]
    bad = qc.where((F.col("status") == "fail") & ~F.col("informational")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("check")), ",").alias("evidence"))
    return runs.where(F.col("status") == "succeeded").select(*keys).join(bad, keys).select(*keys, F.lit("qc_anomaly").alias("failure_class"), "evidence")


def captured_inputs(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """family -> sample -> metric -> value as one nested map for each run."""
    keys = keys or ["run_id"]
    per_sample = metrics.groupBy(*keys, "family", "sample").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    per_family = per_sample.groupBy(*keys, "family").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample", F.struct("m").alias("m"))), lambda a, b: F.when(a["sample"] < b["sample"], -1).otherwise(1))).alias("s"))
    return per_family.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("family", F.transform_values("s", lambda _, v: v["m"])))).alias("verification_inputs"))
