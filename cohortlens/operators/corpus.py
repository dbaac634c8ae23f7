"""Labelled corpora: evaluation, guards against baselines, clusters, trends and promotion of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def diagnose_eval(cases: DataFrame) -> DataFrame:
    """Support, predictions, hits, precision and recall of each class; cases have expected and predicted."""
    rows = cases.select(
        F.explode(F.array(F.struct(F.col("expected").alias("cls"), F.lit(1).alias("e"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("cls"), F.lit(0).alias("e"), F.lit(1).alias("p")))).alias("r"),
        (F.col("expected") == F.col("predicted")).alias("ok"),
    )
    a = rows.groupBy(F.col("r.cls").alias("failure_class")).agg(F.sum("r.e").alias("support"), F.sum("r.p").alias("predicted"), F.sum(F.when(F.col("ok"), F.col("r.e")).otherwise(0)).alias("correct"))
    rate = lambda d: F.when(F.col(d) > 0, F.col("correct") / F.col(d)).otherwise(0.0)
    return a.withColumn("precision", rate("predicted")).withColumn("recall", rate("support"))


def accuracy(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), F.avg((F.col("expected") == F.col("predicted")).cast("double")).alias("accuracy"))


def verify_eval(cases: DataFrame, statuses: DataFrame) -> DataFrame:
    """Matched and total by family. A case matches if its worst status is its label; the match counts for all its families.

    cases: case_id, label (NULL: left out); statuses: case_id, family, status.
    """
    rank = F.when(F.col("status") == "fail", 3).when(F.col("status") == "warn", 2).when(F.col("status") == "pass", 1).otherwise(0)
    worst = statuses.groupBy("case_id").agg(F.max(rank).alias("r"))
    name = F.when(F.col("r") == 3, "fail").when(F.col("r") == 2, "warn").when(F.col("r") == 1, "pass").otherwise("unverified")
    match = cases.where(F.col("label").isNotNull()).join(worst, "case_id").select("case_id", (name == F.col("label")).alias("ok"))
    return statuses.select("case_id", "family").distinct().join(match, "case_id").groupBy("family").agg(F.count_if("ok").alias("matched"), F.count("*").alias("total"), F.avg(F.col("ok").cast("double")).alias("rate"))


def reproduce_eval(claims: DataFrame) -> DataFrame:
    """Matched and total claims of each family: the status derived anew against the expected one."""
    ok = S.claim_status(F.col("claimed"), F.col("observed"), F.col("tolerance")) == F.col("expected")
    return claims.groupBy("family").agg(F.count_if(ok).alias("matched"), F.count("*").alias("total"), F.avg(ok.cast("double")).alias("rate"))


def outcome_eval(outcomes: DataFrame) -> DataFrame:
    """Match and recovery rates of replayed scenarios by class, and over all (class NULL)."""
    ok, rec = F.col("expected_outcome") == F.col("outcome"), F.col("recovered")
    return outcomes.groupingSets([("failure_class",), ()], "failure_class").agg(F.count("*").alias("scenarios"), F.avg(ok.cast("double")).alias("match_rate"), F.avg(rec.cast("double")).alias("recovery_rate"))


def guard(rates: DataFrame, baselines: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Each rate against its baseline: delta, regressed, improved, corpus mismatch, missing baseline."""
    j = rates.alias("r").join(baselines.alias("b"), "guard", "left")
    d = F.col("r.value") - F.col("b.value")
    return j.select(
        "guard", F.col("r.value").alias("value"), F.col("b.value").alias("baseline"), d.alias("delta"), F.coalesce(F.col("r.value") < F.col("b.value") - tolerance, F.lit(False)).alias("regressed"),
        F.coalesce(F.col("r.value") > F.col("b.value") + tolerance, F.lit(False)).alias("improved"), F.coalesce(F.col("r.corpus_sha") != F.col("b.corpus_sha"), F.lit(False)).alias("corpus_changed"), F.col("b.value").isNull().alias("no_baseline"),
    )


def clusters(cases: DataFrame, text: str = "log_text") -> DataFrame:
    """Cases by class and log signature: how many, and their smallest id. Cases that have a signature already need no text."""
    signature = F.col("signature") if "signature" in cases.columns else S.signature(F.col(text))
    return cases.groupBy("failure_class", signature.alias("signature")).agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


def coverage(cases: DataFrame, thin: int = 3) -> DataFrame:
    """Counts by class, by source kind, and over all, with the thin ones marked."""
    c = cases.withColumn("kind", S.source_kind(F.col("source")))
    return c.groupingSets([("failure_class",), ("kind",), ()], "failure_class", "kind").agg(F.count("*").alias("n")).withColumn("is_thin", F.col("n") < thin)


def trend(snapshots: DataFrame) -> DataFrame:
    """Change of each metric since its previous snapshot in points, and whether it is the latest."""
    w = Window.partitionBy("metric").orderBy("ts", "value")
    last = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("ts"), F.desc("value"))) == 1
    return snapshots.select("metric", "ts", "value", ((F.col("value") - F.lag("value").over(w)) * 100).alias("delta_pp"), last.alias("latest"))


def latest_per_detector(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(F.coalesce("detector", F.lit("rules")).alias("detector")).agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "value")).alias("value"))


def append_new_cases(pending: DataFrame, new: DataFrame) -> DataFrame:
    """What a sink appends: new cases whose id isn't pending, once each."""
    return new.dropDuplicates(["case_id"]).join(pending.select("case_id"), "case_id", "left_anti")


def promote(pending: DataFrame, golden: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending and golden tables after decisions (case_id, label), and the decisions that can't be carried out."""
    known = decisions.join(pending.select("case_id"), "case_id", "left_semi").join(golden.select("case_id"), "case_id", "left_anti")
    moved = pending.drop("label").join(known.select("case_id", "label"), "case_id").withColumn("source", F.regexp_replace("source", "^pending:", "confirmed:"))
    errors = decisions.join(known.select("case_id"), "case_id", "left_anti").join(golden.select("case_id", F.lit(True).alias("g")), "case_id", "left")
    errors = errors.select("case_id", F.when(F.col("g"), "already golden").otherwise("unknown case").alias("reason"))
    return pending.join(known.select("case_id"), "case_id", "left_anti"), golden.unionByName(moved.select(golden.columns)), errors


def capture_gate(runs: DataFrame, verdicts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs that succeeded with a fail or warn verdict."""
    keys = keys or ["run_id"]
    return runs.where(F.col("status") == "succeeded").select(*keys).join(verdicts.where(F.col("verdict").isin("fail", "warn")), keys)


def reproduce_capture_gate(results: DataFrame) -> DataFrame:
    """Reproductions with a diverged or unverified claim, a repair, or an exit code other than 0."""
    a = results.groupBy("run_id").agg(F.bool_or(F.col("status").isin("diverged", "unverified")).alias("bad"), F.max("repairs").alias("repairs"), F.max("exit_code").alias("exit_code"))
    return a.where(F.col("bad") | (F.col("repairs") > 0) | (F.col("exit_code") != 0)).select("run_id", "bad", "repairs", "exit_code")
