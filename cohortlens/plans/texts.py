"""Queries over logs, goals, claims, corpora and run files, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as T
from ..operators import claims, corpus, references, runs, text
from .core import ORACLES, QUERIES, query  # noqa: F401
from .views import VIEWS  # noqa: F401


def _has(groups) -> str:
    """A line of the list ls that holds a needle of each group."""
    tests = " AND ".join("(" + " OR ".join(f"contains(lower(x), {_lit(n)})" for n in g) + ")" for g in groups)
    return f"list_filter(ls, lambda x: {tests})"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _diagnose_sql() -> str:
    cls, conf, ev = [], [], []
    for c, p, g in T.FAILURES:
        hit = _has(g)
        fires = f"len({hit}) > 0"
        if c == "oom":
            fires = f"({fires} OR oom)"
        elif c == "conda_solve_failed":
            fires = f"({fires} OR (contains(low, 'conda') AND contains(low, 'solve')))"
        elif c == "platform_unsupported":
            fires = f"({fires} AND noexit)"
        elif c == "alignment_format_mismatch":
            fires = f"({fires} AND contains(low, '.cram'))"
        cls.append(f"WHEN {fires} THEN '{c}'")
        conf.append(f"WHEN {fires} THEN {p}")
        shown = f"CASE WHEN oom THEN list_prepend('exit 137', {hit}) ELSE {hit} END" if c == "oom" else hit
        ev.append(f"WHEN {fires} THEN array_to_string({shown}, '|')")
    last = "list_extract(list_filter(ls, lambda x: trim(x) <> ''), -1)"
    return f"""
WITH f AS (SELECT run_id, coalesce(bool_or(exit_code = 137), false) AS oom, bool_or(coalesce(status = 'FAILED', false) OR coalesce(exit_code <> 0, false)) AS failed,
  bool_or((coalesce(status = 'FAILED', false) OR coalesce(exit_code <> 0, false)) AND exit_code IS NULL) AS noexit FROM log_events GROUP BY 1),
l AS (SELECT logs.run_id, string_split(log_text, chr(10)) AS ls, lower(log_text) AS low, oom, failed, noexit FROM logs LEFT JOIN f USING (run_id)),
dg AS (SELECT run_id, CASE {' '.join(cls)} WHEN failed THEN 'tool_crash' ELSE 'unknown' END AS failure_class, CAST(CASE {' '.join(conf)} WHEN failed THEN 0.4 ELSE 0.2 END AS DOUBLE) AS confidence,
  CASE {' '.join(ev)} WHEN failed THEN {last} ELSE '' END AS evidence, failed, low FROM l)"""


@query("q_op_diagnose", f"{_diagnose_sql()} SELECT run_id, failure_class, confidence, evidence FROM dg")
def _(v, spark):
    return text.diagnose(v("logs"), v("log_events")).withColumn("evidence", F.array_join("evidence", "|"))


_WEAK = "(failure_class = 'platform_unsupported' OR (failure_class = 'conda_solve_failed' AND NOT contains(low, 'resolvepackagenotfound') AND NOT contains(low, 'packagesnotfounderror')))"


@query("q_op_diagnose_strict", f"""{_diagnose_sql()} SELECT run_id, CASE WHEN {_WEAK} THEN CASE WHEN failed THEN 'tool_crash' ELSE 'unknown' END ELSE failure_class END AS failure_class,
CAST(CASE WHEN {_WEAK} THEN CASE WHEN failed THEN 0.4 ELSE 0.2 END ELSE confidence END AS DOUBLE) AS confidence FROM dg""")
def _(v, spark):
    return text.diagnose_strict(text.diagnose(v("logs"), v("log_events")), v("logs"), v("log_events"))


_SAL = "|".join(T.SALIENT)
SIG_SQL = f"""WITH n AS (SELECT run_id AS case_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(log_text), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[t ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?z?', '<ts>', 'g'), '(/[a-z0-9_.\\-]+)+', '<path>', 'g'), '\\b[0-9a-f]{{6,}}\\b', '<hash>', 'g'), '[0-9]+', '<n>', 'g') AS t FROM logs),
q AS (SELECT case_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM n),
sg AS (SELECT case_id, substr(sha256(array_to_string(CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{_SAL}'))) > 0 THEN list_filter(ls, lambda x: regexp_matches(x, '{_SAL}')) ELSE ls END, chr(10))), 1, 16) AS signature FROM q)"""


@query("q_fn_signature", f"{SIG_SQL} SELECT case_id, signature FROM sg")
def _(v, spark):
    return v("logs").select(F.col("run_id").alias("case_id"), S.signature(F.col("log_text")).alias("signature"))


@query("q_op_clusters", f"{_diagnose_sql()}, {SIG_SQL[5:]} SELECT failure_class, signature, count(*) AS n, min(case_id) AS first_case FROM dg JOIN sg ON dg.run_id = sg.case_id GROUP BY 1, 2")
def _(v, spark):
    """What the rules find and the signature are computed where the logs are read; no text moves, neither to the events nor for the grouping."""
    cases = text.diagnose(v("logs"), v("log_events"), beside={"signature": S.signature(F.col("log_text"))}).withColumnRenamed("run_id", "case_id")
    return corpus.clusters(cases)


@query("q_w_log_tail", "SELECT run_id, array_to_string(list_slice(string_split(rtrim(log_text), chr(10)), -2, -1), chr(10)) AS tail FROM logs")
def _(v, spark):
    return text.log_tail(v("logs"), n=2)


_ASSAY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(goal), {_lit(p)})' for p in ps)} THEN '{a}'" for a, ps in T.ASSAYS) + " END"
_PIPE = "CASE assay " + " ".join(f"WHEN '{a}' THEN '{p}'" for a, p in T.PIPELINES) + " END"


@query("q_op_match_assay", f"WITH m AS (SELECT goal_id, {_ASSAY} AS assay FROM goals) SELECT goal_id, assay, {_PIPE} AS pipeline FROM m")
def _(v, spark):
    return text.match_assay(v("goals")).select("goal_id", "assay", "pipeline")


_SHAPE = """sh AS (SELECT sheet_id, CASE WHEN count(*) FILTER (WHERE coalesce(fastq_2, '') <> '') = count(*) THEN 'paired' WHEN count(*) FILTER (WHERE coalesce(fastq_2, '') <> '') = 0 THEN 'single' ELSE 'mixed' END AS layout,
 count(DISTINCT sample) AS n_samples, count(DISTINCT sample) < 2 AS no_replicates FROM sheets GROUP BY 1)"""


@query("q_op_datashape", f"WITH {_SHAPE} SELECT * FROM sh")
def _(v, spark):
    return text.data_shape(v("sheets"))


@query("q_op_plan", f"""WITH {_SHAPE}, m AS (SELECT goal_id, sheet_id, {_ASSAY} AS assay FROM goals)
SELECT goal_id, assay, {_PIPE} AS pipeline, layout, concat_ws('; ', CASE WHEN assay IS NULL THEN 'no assay' END, CASE WHEN layout = 'mixed' THEN 'mixed layout' END, CASE WHEN no_replicates THEN 'no replicates' END) AS warnings FROM m LEFT JOIN sh USING (sheet_id)""")
def _(v, spark):
    return text.plan(v("goals"), text.data_shape(v("sheets")))


@query("q_op_extract_claims")
def _(v, spark):
    """Claims of whole texts. The pattern looks ahead, which the twin's engine can't; tests compare it with brute force."""
    return text.extract_claims(v("claim_texts"))


@query("q_op_diagnose_eval", """WITH k AS (SELECT expected AS c FROM cases UNION SELECT predicted FROM cases)
SELECT c AS failure_class, count(*) FILTER (WHERE expected = c) AS support, count(*) FILTER (WHERE predicted = c) AS predicted, count(*) FILTER (WHERE predicted = c AND expected = c) AS correct,
 coalesce(count(*) FILTER (WHERE predicted = c AND expected = c) / nullif(count(*) FILTER (WHERE predicted = c), 0), 0) AS precision, coalesce(count(*) FILTER (WHERE predicted = c AND expected = c) / nullif(count(*) FILTER (WHERE expected = c), 0), 0) AS recall
FROM k JOIN cases ON expected = c OR cases.predicted = c GROUP BY 1""")
def _(v, spark):
    return corpus.diagnose_eval(v("cases"))


@query("q_op_coverage", "SELECT expected AS failure_class, CASE WHEN GROUPING(split_part(source, ':', 1)) = 0 THEN split_part(source, ':', 1) END AS kind, count(*) AS n, count(*) < 30 AS is_thin FROM cases GROUP BY GROUPING SETS ((expected), (split_part(source, ':', 1)), ())")
def _(v, spark):
    return corpus.coverage(v("cases").withColumn("failure_class", F.col("expected")), thin=30)


@query("q_op_verify_eval", """WITH w AS (SELECT case_id, max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) AS r FROM family_status GROUP BY 1), m AS (SELECT case_id, (CASE r WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END) = label AS ok FROM case_labels JOIN w USING (case_id) WHERE label IS NOT NULL)
SELECT family, count(*) FILTER (WHERE ok) AS matched, count(*) AS total, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS rate FROM family_status JOIN m USING (case_id) GROUP BY 1""")
def _(v, spark):
    return corpus.verify_eval(v("case_labels"), v("family_status"))


_CLAIM = "CASE WHEN observed IS NULL THEN 'unverified' WHEN abs(observed - claimed) <= 1e-9 THEN 'reproduced' WHEN abs(observed - claimed) / abs(claimed) <= tolerance THEN 'within_tolerance' ELSE 'diverged' END"


@query("q_op_reproduce_eval", f"SELECT family, count(*) FILTER (WHERE {_CLAIM} = expected) AS matched, count(*) AS total, avg(CASE WHEN {_CLAIM} = expected THEN 1.0 ELSE 0.0 END) AS rate FROM paper_claims GROUP BY 1")
def _(v, spark):
    return corpus.reproduce_eval(v("paper_claims"))


@query("q_fn_claim_status", f"SELECT run_id, claim_id, claimed, observed, abs(observed - claimed) / abs(claimed) AS delta, {_CLAIM} AS status FROM paper_claims")
def _(v, spark):
    c = v("paper_claims")
    return claims.classify(c.drop("observed"), c.select("run_id", "claim_id", "observed"))


@query("q_op_claim_summary", f"""WITH s AS (SELECT run_id, {_CLAIM} AS status FROM paper_claims)
SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'reproduced') AS reproduced, count(*) FILTER (WHERE status = 'within_tolerance') AS within_tolerance, count(*) FILTER (WHERE status = 'diverged') AS diverged, count(*) FILTER (WHERE status = 'unverified') AS unverified,
 count(*) FILTER (WHERE status IN ('reproduced', 'within_tolerance')) || ' of ' || count(*) || ' claims hold' AS summary FROM s GROUP BY 1""")
def _(v, spark):
    c = v("paper_claims")
    return claims.claim_summary(claims.classify(c.drop("observed"), c.select("run_id", "claim_id", "observed")))


@query("q_op_reproduce_capture_gate", f"SELECT run_id, bool_or({_CLAIM} IN ('diverged', 'unverified')) AS bad, max(repairs) AS repairs, max(exit_code) AS exit_code FROM paper_claims GROUP BY 1 HAVING bool_or({_CLAIM} IN ('diverged', 'unverified')) OR max(repairs) > 0 OR max(exit_code) <> 0")
def _(v, spark):
    c = v("paper_claims")
    return corpus.reproduce_capture_gate(c.withColumn("status", S.claim_status(F.col("claimed"), F.col("observed"), F.col("tolerance"))))


_OBS = "SELECT p_brand AS run_id, 'c' || p_partkey AS claim_id, CASE WHEN p_partkey % 4 IN (1, 2) THEN NULL ELSE CAST(p_size AS DOUBLE) END AS observed, CASE p_partkey % 4 WHEN 1 THEN 'not a number' WHEN 2 THEN 'missing' ELSE 'ok' END AS reason FROM part"


def _part(v):
    return v("parts").select(F.col("p_brand").alias("run_id"), F.concat(F.lit("c"), F.col("p_partkey")).alias("claim_id"), "p_partkey", "p_size")


VIEWS["parts"] = "SELECT p_brand, p_partkey, p_size FROM part"


@query("q_op_claim_observe_json", _OBS)
def _(v, spark):
    c = _part(v)
    value = F.when(F.col("p_partkey") % 4 == 1, F.format_string('"%d"', "p_size")).otherwise(F.col("p_size").cast("string"))
    doc = F.when(F.col("p_partkey") % 4 == 2, "{}").otherwise(F.concat(F.lit('{"a": [{"v": '), value, F.lit("}]}")))
    arts = c.select("run_id", F.col("claim_id").alias("path"), doc.alias("text"))
    return claims.observe_json(c.select("run_id", "claim_id", F.col("claim_id").alias("path"), F.lit("$.a[0].v").alias("pointer")), arts)


@query("q_op_claim_observe_flat", _OBS)
def _(v, spark):
    c = _part(v)
    value = F.when(F.col("p_partkey") % 4 == 1, F.format_string('"%d"', "p_size")).otherwise(F.col("p_size").cast("string"))
    entry = F.when(F.col("p_partkey") % 4 != 2, F.concat(F.lit('"'), "claim_id", F.lit('": '), value))
    docs = c.groupBy("run_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("json"))
    return claims.observe_flat(c.select("run_id", "claim_id"), docs)


@query("q_op_claim_observe_table", "SELECT p_brand AS run_id, 'c' || p_partkey AS claim_id, CASE WHEN p_partkey % 4 IN (1, 2, 3) THEN NULL ELSE CAST(p_size AS DOUBLE) END AS observed, CASE p_partkey % 4 WHEN 1 THEN 'not a number' WHEN 2 THEN 'no row' WHEN 3 THEN 'several rows' ELSE 'ok' END AS reason FROM part")
def _(v, spark):
    c = _part(v).withColumn("path", F.lit("t.tsv")).withColumn("key", F.col("claim_id")).withColumn("column", F.lit("x"))
    value = F.when(F.col("p_partkey") % 4 == 1, "n/a").otherwise(F.col("p_size").cast("string"))
    once = c.where("p_partkey % 4 <> 2").select("run_id", "path", "key", "column", value.alias("value"))
    rows = once.unionByName(c.where("p_partkey % 4 = 3").select("run_id", "path", "key", "column", value.alias("value")))
    return claims.observe_table(c.select("run_id", "claim_id", "path", "key", "column"), rows)


VIEWS["part_rows"] = "SELECT 'r' || CAST(p_partkey % 10 AS STRING) AS run_id, p_partkey, p_size FROM part"
_PAT = "SELECT p_brand AS run_id, 'c' || p_partkey AS claim_id, CASE WHEN p_partkey % 4 IN (1, 2, 3) THEN NULL ELSE CAST(p_size AS DOUBLE) END AS observed, CASE p_partkey % 4 WHEN 1 THEN 'no match' WHEN 2 THEN '{none}' WHEN 3 THEN 'several matches' ELSE 'ok' END AS reason FROM part"


@query("q_op_claim_observe_pattern", _PAT.format(none="no text"))
def _(v, spark):
    c = _part(v).withColumn("path", F.col("claim_id"))
    line = F.concat(F.lit("score = "), F.col("p_size"))
    body = F.when(F.col("p_partkey") % 4 == 1, "no number").when(F.col("p_partkey") % 4 == 3, F.concat(line, F.lit("; "), line)).otherwise(line)
    texts = c.where("p_partkey % 4 <> 2").select("run_id", "path", body.alias("text"))
    return claims.observe_pattern(c.select("run_id", "claim_id", "path", F.lit("score = ([0-9.]+)").alias("pattern")), texts)


@query("q_op_claim_observe_notebook", _PAT.format(none="no cell"))
def _(v, spark):
    c = _part(v).withColumn("path", F.col("claim_id"))
    line = F.concat(F.lit("score = "), F.col("p_size"))
    body = F.when(F.col("p_partkey") % 4 == 1, "no number").when(F.col("p_partkey") % 4 == 3, F.concat(line, F.lit("; "), line)).otherwise(line)
    stream = lambda t, name: F.to_json(F.struct(F.lit("stream").alias("output_type"), F.lit(name).alias("name"), t.alias("text")))
    shown = F.to_json(F.struct(F.lit("execute_result").alias("output_type"), F.struct(F.array(body, F.lit("\n")).alias("text/plain"), F.lit("<b>").alias("text/html")).alias("data")))
    output = F.when(F.col("p_partkey") % 3 == 0, stream(body, "stdout")).when(F.col("p_partkey") % 3 == 1, stream(F.array(body, F.lit(" end")), "stdout")).otherwise(shown)
    cells = F.concat(F.lit('{"cells": [{"cell_type": "markdown", "source": ["Title"]}, {"source": ["a = 1\\n", "show(a)"], "outputs": ['), stream(F.lit("score = 7"), "stderr"), F.lit(", "), output, F.lit(']}, {"source": "b", "outputs": []}]}'))
    books = c.select("run_id", "path", cells.alias("text"))
    cell, search = F.when(F.col("p_partkey") % 4 == 2, 9).otherwise(1), F.col("p_partkey") % 5 == 0
    contains = F.when(search, F.when(F.col("p_partkey") % 4 == 2, "nowhere").otherwise("show(a)"))
    return claims.observe_notebook(c.select("run_id", "claim_id", "path", F.when(~search, cell).alias("cell"), contains.alias("contains"), F.lit("score = ([0-9.]+)").alias("pattern")), books)


@query("q_op_claim_observe_cell", """WITH t AS (SELECT 'r' || CAST(p_partkey % 10 AS STRING) AS run_id, p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size, p_partkey % 70 AS grp, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) - 1 AS n FROM part),
g AS (SELECT run_id, grp, count(*) AS k, any_value(size) AS size FROM t GROUP BY 1, 2),
c AS (SELECT run_id, p_partkey, p_partkey % 5 AS kind, CAST(floor(p_partkey / 10) AS BIGINT) * 2 AS row_at, p_partkey * 7 % 70 AS want FROM t)
SELECT c.run_id, 'c' || CAST(c.p_partkey AS STRING) AS claim_id, CASE kind WHEN 0 THEN own.size WHEN 1 THEN pl.size WHEN 2 THEN CASE WHEN g.k = 1 THEN g.size END END AS observed,
CASE kind WHEN 0 THEN CASE WHEN own.size IS NULL THEN 'not a number' ELSE 'ok' END WHEN 1 THEN CASE WHEN pl.n IS NULL THEN 'no row' WHEN pl.size IS NULL THEN 'not a number' ELSE 'ok' END
WHEN 2 THEN CASE WHEN g.k IS NULL THEN 'no row' WHEN g.k > 1 THEN 'several rows' WHEN g.size IS NULL THEN 'not a number' ELSE 'ok' END WHEN 3 THEN 'no column' ELSE 'several columns' END AS reason
FROM c LEFT JOIN t own ON own.p_partkey = c.p_partkey LEFT JOIN t pl ON pl.run_id = c.run_id AND pl.n = c.row_at LEFT JOIN g ON g.run_id = c.run_id AND g.grp = c.want""")
def _(v, spark):
    """Cells of table files: by key, by place, by a key that may stand in several rows, and by columns that are missing or doubled."""
    from ..sources import readers
    from .files import write

    p = v("part_rows")
    size = F.when(F.col("p_partkey") % 6 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    body = p.select("run_id", F.col("p_partkey").cast("long").alias("n"), F.concat_ws("\t", F.concat(F.lit("i"), "p_partkey"), size, F.concat(F.lit(" g"), F.col("p_partkey") % 70), F.lit("x"), F.lit("x")).alias("value"))
    head = p.select("run_id").distinct().select("run_id", F.lit(-1).cast("long").alias("n"), F.lit("id\tsize\tgrp\ttwin\ttwin").alias("value"))
    lines = readers._text(spark, write(head.unionByName(body)))
    k, text = F.col("p_partkey") % 5, lambda c: F.lit(c).cast("string")
    c = p.select(
        "run_id", F.concat(F.lit("c"), "p_partkey").alias("claim_id"), F.lit(True).alias("header"), F.when(k.isin(0, 2), "size").when(k == 3, "nope").when(k == 4, "twin").alias("column"), F.when(k == 1, 1).alias("column_at"),
        F.when(k == 0, text(None)).when(k == 1, (F.floor(F.col("p_partkey") / 10) * 2).cast("string")).otherwise(F.when(k != 2, text("0"))).cast("long").alias("row_at"),
        F.when(k == 0, "id").when(k == 2, "grp").alias("key_column"), F.when(k == 0, F.concat(F.lit("i"), "p_partkey")).when(k == 2, F.concat(F.lit("g"), F.col("p_partkey") * 7 % 70)).alias("key"),
    )
    return claims.observe_cell(c.join(lines.select("run_id", "path").distinct(), "run_id"), lines)


@query("q_op_freshness", "SELECT run_id, CAST(task_id AS VARCHAR) AS path, ts - INTERVAL 10 DAY < started AS stale FROM tasks JOIN (SELECT run_id, min(started) AS started FROM runs GROUP BY 1) r USING (run_id)")
def _(v, spark):
    arts = v("tasks").select("run_id", F.col("task_id").cast("string").alias("path"), (F.col("ts") - F.expr("interval 10 days")).alias("mtime"))
    return claims.freshness(arts, v("runs").groupBy("run_id").agg(F.min("started").alias("started")))


@query("q_op_guard", """SELECT r.guard, r.value, b.value AS baseline, r.value - b.value AS delta, coalesce(r.value < b.value - 0.001, false) AS regressed, coalesce(r.value > b.value + 0.001, false) AS improved, coalesce(r.corpus_sha <> b.corpus_sha, false) AS corpus_changed, b.value IS NULL AS no_baseline
FROM rates r LEFT JOIN baselines b ON r.guard = b.guard""")
def _(v, spark):
    return corpus.guard(v("rates"), v("baselines"), 0.001)


@query("q_w_trend", "SELECT metric, ts, value, (value - lag(value) OVER (PARTITION BY metric ORDER BY ts)) * 100 AS delta_pp, row_number() OVER (PARTITION BY metric ORDER BY ts DESC) = 1 AS latest FROM snapshots")
def _(v, spark):
    return corpus.trend(v("snapshots"))


@query("q_w_latest_per_detector", "SELECT coalesce(detector, 'rules') AS detector, max(ts) AS ts, arg_max(value, ts) AS value FROM snapshots GROUP BY 1")
def _(v, spark):
    return corpus.latest_per_detector(v("snapshots"))


@query("q_op_outcome_eval", "SELECT failure_class, count(*) AS scenarios, avg(CASE WHEN outcome = 'succeeded' THEN 1.0 ELSE 0.0 END) AS match_rate, avg(CASE WHEN patch_applied THEN 1.0 ELSE 0.0 END) AS recovery_rate FROM steps GROUP BY GROUPING SETS ((failure_class), ())")
def _(v, spark):
    return corpus.outcome_eval(v("steps").withColumn("expected_outcome", F.lit("succeeded")).withColumn("recovered", F.col("patch_applied")))


@query("q_snk_case_append", "SELECT DISTINCT case_id, expected FROM cases WHERE source <> 'pending:auto' OR CAST(case_id AS BIGINT) % 4 = 0")
def _(v, spark):
    c = v("cases").select("case_id", "expected", "source")
    pending = c.where("source = 'pending:auto' AND cast(case_id AS bigint) % 4 <> 0")
    return corpus.append_new_cases(pending, c).select("case_id", "expected")


@query("q_snk_promote", """WITH p AS (SELECT * FROM cases WHERE source = 'pending:auto'), g AS (SELECT * FROM cases WHERE source <> 'pending:auto')
SELECT case_id, CASE WHEN CAST(case_id AS BIGINT) % 3 = 0 THEN 'relabelled' ELSE expected END AS label, 'confirmed:auto' AS source FROM p WHERE CAST(case_id AS BIGINT) % 3 = 0 UNION ALL SELECT case_id, expected, source FROM g""")
def _(v, spark):
    c = v("cases").select("case_id", F.col("expected").alias("label"), "source")
    decisions = c.where("cast(case_id AS bigint) % 3 = 0").select("case_id", F.lit("relabelled").alias("label"))
    return corpus.promote(c.where("source = 'pending:auto'"), c.where("source <> 'pending:auto'"), decisions)[1]


@query("q_op_run_diff", """WITH a AS (SELECT * FROM items WHERE run_id = 'y0'), b AS (SELECT * FROM items WHERE run_id = 'y1')
SELECT 'p' AS pair_id, coalesce(a.section, b.section) AS section, coalesce(a."key", b."key") AS "key", a.value AS value_a, b.value AS value_b, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' WHEN a.value = b.value THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.section = b.section AND a."key" = b."key" """)
def _(v, spark):
    return runs.run_diff(v("items"), spark.createDataFrame([("p", "y0", "y1")], "pair_id string, a string, b string"))


@query("q_op_benchmark_run", """WITH e AS (SELECT DISTINCT b.run_id || b.pipeline AS run_id, r."check", r.value AS reference_value FROM bench b JOIN bench_reference r ON b.pipeline = r.pipeline), h AS (SELECT run_id || pipeline AS run_id, "check", value AS run_value FROM bench),
j AS (SELECT coalesce(h.run_id, e.run_id) AS run_id, abs(run_value - reference_value) / abs(reference_value) AS delta, reference_value FROM h FULL JOIN e ON h.run_id = e.run_id AND h."check" = e."check")
SELECT run_id, count(*) FILTER (WHERE coalesce(delta <= 0.05, false)) AS matched, count(*) FILTER (WHERE NOT coalesce(delta <= 0.05, false)) AS drifted, CASE WHEN count(reference_value) = 0 THEN 'no_reference' WHEN count(*) FILTER (WHERE NOT coalesce(delta <= 0.05, false)) = 0 THEN 'match' ELSE 'drift' END AS status FROM j GROUP BY 1""")
def _(v, spark):
    return runs.benchmark_summary(runs.benchmark_run(v("bench").withColumn("run_id", F.concat("run_id", "pipeline")), v("bench_reference")))


@query("q_snk_reference_upsert", """SELECT pipeline, "check", value FROM bench_reference WHERE pipeline <> 'p1' UNION ALL SELECT pipeline, "check", value + 1 FROM bench_reference WHERE pipeline = 'p1'""")
def _(v, spark):
    r = v("bench_reference")
    return runs.reference_upsert(r, r.where("pipeline = 'p1'").withColumn("value", F.col("value") + 1), ["pipeline"])


@query("q_op_output_integrity", """WITH j AS (SELECT a.run_id, a.path, a.sha256 AS was, n.sha256 AS now FROM (SELECT run_id, path, min(sha256) AS sha256 FROM artifacts GROUP BY 1, 2) a LEFT JOIN (SELECT run_id, path, min(sha256) AS sha256 FROM artifacts_now GROUP BY 1, 2) n USING (run_id, path))
SELECT run_id, count(*) FILTER (WHERE now IS NULL) AS missing, count(*) FILTER (WHERE now <> was) AS changed, min(path) FILTER (WHERE now IS NULL OR now <> was) AS first_bad, coalesce(string_agg(path, '|' ORDER BY path) FILTER (WHERE now IS NULL), '') AS missing_paths, coalesce(string_agg(path, '|' ORDER BY path) FILTER (WHERE now <> was), '') AS changed_paths, count(*) FILTER (WHERE now IS NULL OR now <> was) = 0 AS ok FROM j GROUP BY 1""")
def _(v, spark):
    one = lambda n: v(n).groupBy("run_id", "path").agg(F.min("sha256").alias("sha256"))
    out = runs.output_integrity(one("artifacts"), one("artifacts_now"))
    return out.withColumn("missing_paths", F.array_join("missing_paths", "|")).withColumn("changed_paths", F.array_join("changed_paths", "|"))


_MAN = ", ".join(f"('{a}', '{g}', '{r}', '{runs._glob(g)}')" for a, g, r in T.MANIFESTS)


@query("q_op_manifest_check", f"""WITH rn AS (SELECT DISTINCT run_id, CASE CAST(substr(run_id, 2) AS INT) % 4 WHEN 0 THEN 'rnaseq' WHEN 1 THEN 'variant_calling' WHEN 2 THEN 'mag' ELSE 'ampliseq' END AS assay FROM artifacts), w AS (SELECT run_id, pattern, role, rx FROM rn JOIN (VALUES {_MAN}) AS m(assay, pattern, role, rx) USING (assay)),
f AS (SELECT run_id, pattern, count(*) AS n, min(size) AS least FROM artifacts JOIN w USING (run_id) WHERE regexp_matches(split_part(path, '/', 3), rx) GROUP BY 1, 2)
SELECT run_id, pattern, coalesce(n, 0) AS n_files, CASE WHEN n IS NULL THEN CASE WHEN role = 'required' THEN 'fail' ELSE 'warn' END WHEN least = 0 THEN 'fail' ELSE 'pass' END AS status FROM w LEFT JOIN f USING (run_id, pattern)""")
def _(v, spark):
    k = F.substring("run_id", 2, 9).cast("int") % 4
    assay = F.when(k == 0, "rnaseq").when(k == 1, "variant_calling").when(k == 2, "mag").otherwise("ampliseq")
    return runs.manifest_check(v("artifacts").select("run_id", assay.alias("assay")), v("artifacts"), runs.manifest(spark))


@query("q_op_output_count", f"""WITH rn AS (SELECT DISTINCT run_id, CASE CAST(substr(run_id, 2) AS INT) % 4 WHEN 0 THEN 'rnaseq' WHEN 1 THEN 'variant_calling' WHEN 2 THEN 'mag' ELSE 'ampliseq' END AS assay, CAST(substr(run_id, 2) AS INT) AS k FROM artifacts), w AS (SELECT run_id, k, pattern, role, rx FROM rn JOIN (VALUES {_MAN}) AS m(assay, pattern, role, rx) USING (assay)),
f AS (SELECT run_id, pattern, count(*) AS n, min(size) AS least FROM artifacts JOIN w USING (run_id) WHERE regexp_matches(split_part(path, '/', 3), rx) GROUP BY 1, 2)
SELECT run_id, pattern, coalesce(n, 0) AS n_files, CASE WHEN n IS NULL AND role = 'required' THEN 'fail' WHEN least = 0 THEN 'fail' WHEN k % 3 <> 0 AND coalesce(n, 0) < k THEN 'fail' WHEN k % 3 <> 0 AND coalesce(n, 0) > k THEN 'warn' WHEN n IS NULL AND (k % 3 = 0 OR k > 0) THEN 'warn' ELSE 'pass' END AS status FROM w LEFT JOIN f USING (run_id, pattern)""")
def _(v, spark):
    """Two thirds of the runs say how many files each pattern should find."""
    number = F.substring("run_id", 2, 9).cast("int")
    k = number % 4
    assay = F.when(k == 0, "rnaseq").when(k == 1, "variant_calling").when(k == 2, "mag").otherwise("ampliseq")
    rn, man = v("artifacts").select("run_id", assay.alias("assay")), runs.manifest(spark)
    counts = rn.distinct().where(number % 3 != 0).join(F.broadcast(man), "assay").select("run_id", "pattern", number.alias("expected"))
    return runs.manifest_check(rn, v("artifacts"), man, counts)


@query("q_op_index_present", """WITH b AS (SELECT run_id, path FROM artifacts WHERE path LIKE '%.bam'), h AS (SELECT DISTINCT run_id, regexp_replace(path, '\\.bai$', '') AS path FROM artifacts WHERE path LIKE '%.bai')
SELECT b.run_id, b.path, CASE WHEN h.path IS NULL THEN 'fail' ELSE 'pass' END AS status FROM b LEFT JOIN h ON b.run_id = h.run_id AND b.path = h.path""")
def _(v, spark):
    return runs.index_present(v("artifacts"))


@query("q_op_tree_digest", "SELECT run_id, sha256(string_agg(path || chr(0) || sha256 || chr(10), '' ORDER BY path, sha256)) AS tree_sha256, count(*) AS n_files FROM artifacts GROUP BY 1")
def _(v, spark):
    return runs.tree_digest(v("artifacts"))


@query("q_op_input_checksums", "SELECT run_id, split_part(path, '/', 3) AS name, min(sha256) AS sha256, count(*) > 1 AS ambiguous FROM artifacts GROUP BY 1, 2")
def _(v, spark):
    return runs.input_checksums(v("artifacts"))


@query("q_op_samplesheet_validate", """SELECT sheet_id, sample AS "at", 'duplicate sample' AS issue FROM sheets WHERE sample <> '' GROUP BY 1, 2 HAVING count(*) > 1
UNION SELECT sheet_id, sample, 'empty field' FROM sheets WHERE fastq_1 = '' UNION SELECT sheet_id, sample, 'missing file' FROM sheets WHERE fastq_1 <> '' AND fastq_1 NOT IN (SELECT 'f' || p_partkey || '.fq' FROM parts WHERE p_size <> 7)""")
def _(v, spark):
    arts = v("parts").where("p_size <> 7").select(F.concat(F.lit("f"), "p_partkey", F.lit(".fq")).alias("path"))
    return runs.samplesheet_validate(v("sheets"), arts)


@query("q_op_tumor_normal_pairing", """SELECT DISTINCT patient, 'bad status' AS issue FROM sheets WHERE status NOT IN ('0', '1') UNION ALL SELECT patient, 'no normal' FROM sheets GROUP BY 1 HAVING bool_or(status = '1') AND NOT bool_or(status = '0')""")
def _(v, spark):
    return runs.tumor_normal_pairing(v("sheets"))


@query("q_op_visible_runs", """SELECT DISTINCT run_id, assay FROM runs WHERE run_id = 'u3' OR assay = 'mag'""")
def _(v, spark):
    r = v("runs").select("run_id", "assay", F.col("run_id").alias("owner"), F.col("assay").alias("workspace")).distinct()
    return runs.visible_runs(r, "u3", ["mag"]).select("run_id", "assay")


@query("q_op_sequence_consistency", """WITH f AS (SELECT DISTINCT run_id, name FROM fasta_names), g AS (SELECT DISTINCT run_id, name FROM gtf_names),
j AS (SELECT coalesce(f.run_id, g.run_id) AS run_id, f.name AS a, g.name AS b FROM f FULL JOIN g ON f.run_id = g.run_id AND f.name = g.name),
r AS (SELECT run_id, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS shared, count(a) AS nf, count(b) AS ng, count(*) FILTER (WHERE b IS NULL AND a LIKE 'chr%') AS cf, count(*) FILTER (WHERE a IS NULL AND b LIKE 'chr%') AS cg FROM j GROUP BY 1)
SELECT run_id, shared, CASE WHEN nf > 0 AND ng > 0 AND shared = 0 THEN 'mismatch' ELSE 'ok' END AS issue, CASE WHEN nf > 0 AND ng > 0 AND shared = 0 AND cf > 0 AND cg = 0 THEN 'add chr' WHEN nf > 0 AND ng > 0 AND shared = 0 AND cf = 0 AND cg > 0 THEN 'strip chr' END AS hint FROM r""")
def _(v, spark):
    return references.sequence_consistency(v("fasta_names"), v("gtf_names"))


def _plan(v, spark):
    aliases = references.alias_table(spark.createDataFrame([("MT", "M"), ("7", "seven")], "a string, b string"))[0]
    return references.harmonize_plan(v("fasta_names"), v("gtf_names"), aliases)


_PLAN = """WITH al(name, grp) AS (VALUES ('MT', 'M'), ('M', 'M'), ('7', '7'), ('seven', '7')), g AS (SELECT DISTINCT run_id, name AS old FROM gtf_names), f AS (SELECT DISTINCT run_id, name FROM fasta_names),
v1 AS (SELECT run_id, old, unnest(list_distinct([old, regexp_replace(old, '^chr', ''), 'chr' || regexp_replace(old, '^chr', '')])) AS name FROM g),
v2 AS (SELECT DISTINCT v1.run_id, old, b.name FROM v1 JOIN al a ON v1.name = a.name JOIN al b ON a.grp = b.grp),
v3 AS (SELECT run_id, old, name FROM v1 UNION SELECT run_id, old, unnest([name, regexp_replace(name, '^chr', ''), 'chr' || regexp_replace(name, '^chr', '')]) FROM v2),
b AS (SELECT run_id, old, CASE WHEN bool_or(name = old) THEN old ELSE min(name) END AS new_name FROM (SELECT DISTINCT * FROM v3) JOIN f USING (run_id, name) GROUP BY 1, 2),
ok AS (SELECT run_id FROM b GROUP BY 1 HAVING count(*) = count(DISTINCT new_name) AND bool_or(old <> new_name)),
pl AS (SELECT run_id, old AS name, new_name, CASE WHEN new_name = 'chr' || old THEN 'add_chr' WHEN old = 'chr' || new_name THEN 'strip_chr' ELSE 'alias' END AS direction FROM b SEMI JOIN ok USING (run_id) WHERE old <> new_name)"""


@query("q_op_harmonize_plan", f"{_PLAN} SELECT * FROM pl")
def _(v, spark):
    return _plan(v, spark)


@query("q_op_harmonize_rows", f"""{_PLAN}, ln AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY name) AS line_no, name FROM (SELECT DISTINCT run_id, name FROM gtf_names))
SELECT ln.run_id, CAST(line_no AS INT) AS line_no, CASE WHEN line_no % 5 = 0 THEN '#' || ln.name || chr(9) || 'exon' ELSE coalesce(new_name, ln.name) || chr(9) || 'exon' END AS line FROM ln LEFT JOIN pl ON ln.run_id = pl.run_id AND ln.name = pl.name""")
def _(v, spark):
    from pyspark.sql import Window

    names = v("gtf_names").distinct().withColumn("line_no", F.row_number().over(Window.partitionBy("run_id").orderBy("name")))
    line = F.concat(F.when(F.col("line_no") % 5 == 0, "#").otherwise(""), "name", F.lit("\texon"))
    return references.harmonize_rows(names.select("run_id", "line_no", line.alias("line")), _plan(v, spark))


@query("q_op_unmatched", "SELECT DISTINCT run_id, name FROM gtf_names EXCEPT SELECT run_id, name FROM fasta_names")
def _(v, spark):
    return references.unmatched(v("fasta_names"), v("gtf_names"))
