"""Logs and free text: failure diagnosis, signatures, claims, and goals routed to pipelines."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import scalars as S
from ..functions.tables import ASSAYS, CONNECTIVES, FAILURES, INEQUALITIES, METRIC_WORDS, PIPELINES


def _on_a_line(hits: Column, *groups: list[str]) -> Column:
    """Found lines that hold a needle of each group."""
    return F.filter(hits, lambda h: reduce(and_, [h["line"].rlike("|".join(re.escape(n) for n in g)) for g in groups]))


def diagnose(logs: DataFrame, events: DataFrame | None = None, keys: list[str] | None = None, text: str = "log_text", beside: dict[str, Column] | None = None) -> DataFrame:
    """failure_class, confidence and evidence of each log; ordered rules, the first that fires wins. ``beside`` names more that is to be computed from a log's row.

    events adds, for each run, whether a task ended with 137, failed, or failed without an exit code. The rules are
    decided where a log is read, from the few lines that hold a needle; only what they found meets the events, never a text.
    """
    keys, beside = keys or ["run_id"], beside or {}
    place = {cls: i for i, (cls, _, _) in enumerate(FAILURES)}
    oom, host = place["oom"], place["platform_unsupported"]
    whole, hits, rule, found = F.coalesce(F.col(text), F.lit("")), F.col("__hits"), F.col("__rule"), F.col("__lines")
    none = F.array().cast("array<string>")

    # A line that decides a rule holds a needle of its first group, or one of the words that count anywhere in the log.
    needles = sorted({n for _, _, groups in FAILURES for n in groups[0]} | {"conda", "solve", ".cram"})
    logs = logs.select(
        *keys, L.grep(F.lower(F.col(text)), needles).alias("__hits"), F.split(F.replace(whole, F.lit("\r\n"), F.lit("\n")), "\n").alias("__lines"), *[c.alias(n) for n, c in beside.items()]
    )
    first, decisive = F.lit(None).cast("int"), F.slice(hits, 1, 0)
    for i, (cls, _, groups) in reversed(list(enumerate(FAILURES))):
        if i == host:  # decided beside the others, since it counts only with an event
            continue
        hit = _on_a_line(hits, *groups)
        fires = F.size(hit) > 0
        if cls == "conda_solve_failed":
            fires = fires | ((F.size(_on_a_line(hits, ["conda"])) > 0) & (F.size(_on_a_line(hits, ["solve"])) > 0))
        elif cls == "alignment_format_mismatch":
            fires = fires & (F.size(_on_a_line(hits, [".cram"])) > 0)
        first = F.when(fires, F.lit(i)).otherwise(first)
        decisive = F.when(rule == i, hit).otherwise(decisive)
    last = F.filter(found, lambda x: F.trim(x) != "")
    on_host = _on_a_line(hits, *FAILURES[host][2])
    shown = lambda of: F.transform(of, lambda h: F.get(found, h["at"]))
    logs = logs.withColumn("__rule", first)
    logs = logs.select(*keys, "__rule", (F.size(on_host) > 0).alias("__host"), shown(decisive).alias("__evidence"), shown(on_host).alias("__on_host"), F.slice(last, F.greatest(F.size(last), F.lit(1)), 1).alias("__last"), *beside)
    if events is not None:
        failed = S.task_failed(F.col("status"), F.col("exit_code"))
        flags = events.groupBy(*keys).agg(
            F.coalesce(F.bool_or(F.col("exit_code") == 137), F.lit(False)).alias("__oom"), F.bool_or(failed).alias("__failed"), F.bool_or(failed & F.col("exit_code").isNull()).alias("__noexit")
        )
        logs = logs.join(flags, keys, "left")
    flag = (lambda n: F.coalesce(F.col(n), F.lit(False))) if events is not None else (lambda n: F.lit(False))
    logs = logs.withColumn("__first", F.least(rule, F.when(flag("__oom"), F.lit(oom)), F.when(flag("__noexit") & F.col("__host"), F.lit(host))))
    first = F.col("__first")
    cls = F.coalesce(F.get(F.array(*[F.lit(c) for c, _, _ in FAILURES]), first), F.when(flag("__failed"), "tool_crash").otherwise("unknown"))
    conf = F.coalesce(F.get(F.array(*[F.lit(c) for _, c, _ in FAILURES]), first), F.when(flag("__failed"), 0.4).otherwise(0.2))
    killed = F.when(flag("__oom") & (first == oom), F.array(F.lit("exit 137"))).otherwise(none)
    shown_lines = F.when(first == host, F.col("__on_host")).when(first == rule, F.col("__evidence")).otherwise(none)
    lines = F.when(first.isNull(), F.when(flag("__failed"), F.col("__last")).otherwise(none)).otherwise(F.concat(killed, shown_lines))
    return logs.select(*keys, cls.alias("failure_class"), conf.alias("confidence"), lines.alias("evidence"), *beside)


def diagnose_strict(diagnosed: DataFrame, logs: DataFrame, events: DataFrame, keys: list[str] | None = None, text: str = "log_text") -> DataFrame:
    """Platform and weak conda diagnoses demoted to tool_crash if a task failed, else unknown."""
    keys = keys or ["run_id"]
    failed = events.groupBy(*keys).agg(F.bool_or(S.task_failed(F.col("status"), F.col("exit_code"))).alias("__failed"))
    strong = F.lower(text).rlike("resolvepackagenotfound|packagesnotfounderror")
    df = diagnosed.join(logs.select(*keys, strong.alias("__strong")), keys).join(failed, keys, "left")
    weak = (F.col("failure_class") == "platform_unsupported") | ((F.col("failure_class") == "conda_solve_failed") & ~F.coalesce("__strong", F.lit(False)))
    crash = F.coalesce("__failed", F.lit(False))
    cls = F.when(weak, F.when(crash, "tool_crash").otherwise("unknown")).otherwise(F.col("failure_class"))
    conf = F.when(weak, F.when(crash, 0.4).otherwise(0.2)).otherwise(F.col("confidence"))
    return df.select(*keys, cls.alias("failure_class"), conf.alias("confidence"))


def log_tail(logs: DataFrame, keys: list[str] | None = None, text: str = "log_text", n: int = 40) -> DataFrame:
    """The last n lines without trailing blanks and terminal colours."""
    keys = keys or ["run_id"]
    plain = F.rtrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\x1b\\[[0-9;]*[A-Za-z]", ""))
    lines = F.split(plain, "\n")
    return logs.select(*keys, F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n").alias("tail"))


def match_assay(goals: DataFrame, goal: str = "goal") -> DataFrame:
    """Assay and pipeline of free-text goals, NULL (declined) if no phrase occurs."""
    out = F.lit(None).cast("string")
    low = F.lower(goal)
    for assay, phrases in reversed(ASSAYS):
        out = F.when(low.rlike("|".join(re.escape(p) for p in phrases)), assay).otherwise(out)
    pipeline = F.lit(None).cast("string")
    for assay, name in PIPELINES:
        pipeline = F.when(F.col("assay") == assay, name).otherwise(pipeline)
    return goals.withColumn("assay", out).withColumn("pipeline", pipeline)


def data_shape(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Layout of a sample sheet: paired, single or mixed; and whether it has replicates."""
    keys = keys or ["sheet_id"]
    paired = F.coalesce(F.col("fastq_2"), F.lit("")) != ""
    a = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(paired).alias("p"), F.count_distinct("sample").alias("n_samples"))
    layout = F.when(F.col("p") == F.col("n"), "paired").when(F.col("p") == 0, "single").otherwise("mixed")
    return a.select(*keys, layout.alias("layout"), "n_samples", (F.col("n_samples") < 2).alias("no_replicates"))


def plan(goals: DataFrame, shapes: DataFrame) -> DataFrame:
    """Goal rows with assay, pipeline and warnings of their sample sheet."""
    df = match_assay(goals).join(shapes, "sheet_id", "left")
    warnings = F.concat_ws("; ", F.when(F.col("assay").isNull(), "no assay"), F.when(F.col("layout") == "mixed", "mixed layout"), F.when(F.col("no_replicates"), "no replicates"))
    return df.select("goal_id", "assay", "pipeline", "layout", warnings.alias("warnings"))


def extract_claims(docs: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """Metric words with the first number within 40 characters of a connective, one row for each (slug, value) of a text.

    The longest word wins; no other metric and no inequality may stand between; a % makes the unit percent.
    """
    keys = keys or ["doc_id"]
    words = sorted(METRIC_WORDS, key=lambda w: (-len(w), w))
    word = "|".join(re.escape(w) for w in words)
    number = r"[-+]?[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?"
    # a pass over the text finds each word with what follows, up to the number; the parts are taken from that
    phrase = rf"(?:{word})(?![a-z0-9])[^0-9]{{0,40}}?{number}(?:\s*%)?"
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9])(?=({phrase}))(?:{word})(?![a-z0-9])"), F.lit(1))
    part = lambda i: F.regexp_extract("found", rf"^({word})(?![a-z0-9])([^0-9]{{0,40}}?)({number})(\s*%)?", i)
    rows = docs.select(*keys, F.posexplode(found).alias("pos", "found")).select(*keys, "pos", *[part(i).alias(n) for i, n in enumerate(("metric", "gap", "number", "unit"), 1)])
    tokens = "|".join(re.escape(c) if not c.isalpha() else rf"\b{c}\b" for c in CONNECTIVES)
    stop = "|".join(re.escape(x) for x in INEQUALITIES)
    ok = F.col("gap").rlike(tokens) & ~F.col("gap").rlike(rf"(?<![a-z0-9])({word})(?![a-z0-9])") & ~F.trim("gap").rlike(rf"({stop})$")
    slug = F.regexp_replace(F.regexp_replace("metric", "²", "2"), "[^a-z0-9]+", "_")
    out = rows.where(ok).select(*keys, "pos", slug.alias("slug"), F.col("number").try_cast("double").alias("value"), F.when(F.trim("unit") == "%", "percent").alias("unit"))
    first = out.groupBy(*keys, "slug", "value").agg(F.min(F.struct("pos", "unit")).alias("f")).select(*keys, "slug", "value", "f.*")
    n = F.row_number().over(Window.partitionBy(*keys, "slug").orderBy("pos"))
    return first.withColumn("n", n).select(*keys, F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", "n")).alias("claim_id"), F.col("slug").alias("metric"), "value", "unit")


def merge_claims(core: DataFrame, extra: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Claims of two extractors; the first wins on (metric, value)."""
    keys = [*(keys or ["doc_id"]), "metric", "value"]
    return core.unionByName(extra.join(core.select(*keys), keys, "left_anti"))


def routing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PIPELINES, "assay string, pipeline string")
