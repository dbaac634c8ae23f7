"""Queries over call sets, counts, metrics and task events, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import counts, qc, repair, variants
from .views import duck, spark_view

QUERIES: dict = {}
ORACLES: dict = {}
ORDER = ["o1", "o2", "o3"]


def query(name: str, sql: str | None = None):
    """Register a query that takes a view reader, and its twin."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda v: spark_view(spark, sf_dir, v), spark)
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return add


GT_SQL = "CASE WHEN list_aggregate(list_transform(string_split(replace(trim(gt), '|', '/'), '/'), lambda a: CASE WHEN a IN ('', '.') THEN 0 ELSE 1 END), 'max') = 0 THEN NULL ELSE array_to_string(list_sort(string_split(replace(trim(gt), '|', '/'), '/')), '/') END"


def sites(view: str) -> str:
    return f"SELECT run_id, chrom, pos, ref, alt, last({GT_SQL} ORDER BY o1, o2, o3) AS g FROM {view} GROUP BY ALL"


BAND = "CASE WHEN value IS NULL OR isnan(value) THEN 'unverified' WHEN value < fail_below OR value > fail_above THEN 'fail' WHEN value < warn_below OR value > warn_above THEN 'warn' ELSE 'pass' END"
_LO, _HI = "CAST(coalesce(warn_below, fail_below) AS DECIMAL(18, 2))", "CAST(coalesce(warn_above, fail_above) AS DECIMAL(18, 2))"
RANGE = f"CASE WHEN {_LO} IS NOT NULL AND {_HI} IS NOT NULL THEN '[' || {_LO} || ', ' || {_HI} || ']' WHEN {_LO} IS NOT NULL THEN '>= ' || {_LO} WHEN {_HI} IS NOT NULL THEN '<= ' || {_HI} END"


def pack_sql(*packs: str) -> str:
    lit = lambda v, t: f"CAST({'NULL' if v is None else repr(v)} AS {t})"
    rows = [f"({', '.join(lit(v, 'VARCHAR' if i in (0, 1, 6) else 'DOUBLE') for i, v in enumerate(r[1:]))})" for r in T.RULES if r[0] in packs]
    return f'(VALUES {", ".join(rows)}) AS p("check", metric, fail_below, warn_below, warn_above, fail_above, unit)'


@query("q_op_genotype_concordance", f"""
WITH a AS ({sites('calls_a')}), b AS ({sites('calls_b')}),
j AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, a.pos IS NOT NULL AND b.pos IS NOT NULL AS s, a.g AS ga, b.g AS gb FROM a FULL JOIN b ON a.run_id = b.run_id AND a.chrom = b.chrom AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt),
r AS (SELECT run_id, count(*) FILTER (WHERE s) AS shared, count(*) AS n_union, count(*) FILTER (WHERE s AND ga IS NOT NULL AND gb IS NOT NULL) AS comparable, count(*) FILTER (WHERE s AND ga = gb) AS concordant FROM j GROUP BY 1)
SELECT *, concordant / nullif(comparable, 0) AS rate, shared / n_union AS overlap,
       CASE WHEN comparable = 0 THEN 'unverified' WHEN concordant / comparable < 0.9 THEN 'warn' ELSE 'pass' END AS rate_status, CASE WHEN shared / n_union < 0.9 THEN 'warn' ELSE 'pass' END AS overlap_status FROM r""")
def _(v, spark):
    return variants.genotype_concordance(v("calls_a"), v("calls_b"), order=ORDER)


@query("q_op_somatic_overlap", """
WITH a AS (SELECT DISTINCT run_id, chrom, pos, ref, alt FROM calls_a WHERE filter IN ('PASS', '.')), b AS (SELECT DISTINCT run_id, chrom, pos, ref, alt FROM calls_b WHERE filter IN ('PASS', '.')),
u AS (SELECT run_id, count(*) AS n_union, count(*) FILTER (WHERE n = 2) AS shared FROM (SELECT run_id, chrom, pos, ref, alt, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) GROUP BY 1)
SELECT run_id, shared, n_union, shared / n_union AS jaccard, CASE WHEN n_union < 10 THEN 'unverified' WHEN shared / n_union < 0.9 THEN 'warn' ELSE 'pass' END AS status FROM u""")
def _(v, spark):
    return variants.somatic_overlap(v("calls_a"), v("calls_b"))


@query("q_src_vcf_union", "SELECT run_id, count(*) AS n_sites FROM (SELECT run_id, chrom, pos, ref, alt FROM calls_a WHERE filter = 'PASS' UNION SELECT run_id, chrom, pos, ref, alt FROM calls_b WHERE filter = '.') GROUP BY 1")
def _(v, spark):
    cols = ["run_id", *variants.SITE]
    u = variants.site_union(v("calls_a").where("filter = 'PASS'").select(*cols), v("calls_b").where("filter = '.'").select(*cols))
    return u.groupBy("run_id").agg(F.count("*").alias("n_sites"))


_SNV = "ref IN ('A','C','G','T') AND alt IN ('A','C','G','T')"
_TI = "ref || alt IN ('AG','GA','CT','TC')"
_TWO = "len(string_split(g, '/')) = 2"
_DIFF = "split_part(g, '/', 1) <> split_part(g, '/', 2)"
METRICS_SQL = f"""
WITH s AS ({sites('calls_a')}),
w AS (SELECT run_id, count(*) FILTER (WHERE {_SNV} AND {_TI}) / nullif(count(*) FILTER (WHERE {_SNV} AND NOT {_TI}), 0) AS ts_tv,
      count(*) FILTER (WHERE {_TWO} AND {_DIFF}) / nullif(count(*) FILTER (WHERE {_TWO} AND NOT {_DIFF} AND split_part(g, '/', 1) <> '0'), 0) AS het_hom, CAST(count(*) AS DOUBLE) AS variant_count FROM s GROUP BY 1)"""
for _name in ("ts_tv", "het_hom", "variant_count"):

    @query(f"q_op_{_name}", f"{METRICS_SQL} SELECT run_id, {_name} FROM w")
    def _(v, spark, name=_name):
        return variants.variant_metrics(v("calls_a"), order=ORDER).select("run_id", name)


@query("q_op_variant_plausibility", f"""{METRICS_SQL},
m AS (SELECT run_id, 'all' AS sample, 'ts_tv' AS metric, ts_tv AS value FROM w UNION ALL SELECT run_id, 'all', 'het_hom', het_hom FROM w UNION ALL SELECT run_id, 'all', 'variant_count', variant_count FROM w)
SELECT r.run_id, 'all' AS sample, p."check" || ':all' AS "check", {BAND} AS status, value, {RANGE} AS expected_range, coalesce(fail_below, warn_below, warn_above, fail_above) IS NULL AS informational
FROM (SELECT DISTINCT run_id FROM m) r CROSS JOIN {pack_sql('variant_calling')} LEFT JOIN m ON m.run_id = r.run_id AND m.metric = p.metric""")
def _(v, spark):
    m = variants.as_metrics(variants.variant_metrics(v("calls_a"), order=ORDER), ["ts_tv", "het_hom", "variant_count"])
    return qc.rule_eval_required(m, m, qc.rules(spark, "variant_calling"))


_PAR37 = " OR ".join(f"(regexp_replace(lower(chrom), '^chr', '') = '{c.lower()}' AND pos BETWEEN {lo} AND {hi})" for b, c, lo, hi in T.PAR if b == "GRCh37")
SEX_SQL = f"""
WITH s AS (SELECT * FROM ({sites('calls_a')}) WHERE NOT ({_PAR37})),
x AS (SELECT run_id, count(*) FILTER (WHERE chrom = 'chrX' AND {_SNV} AND g IS NOT NULL AND {_TWO} AND NOT contains(g, '.')) AS x_sites,
      count(*) FILTER (WHERE chrom = 'chrX' AND {_SNV} AND g IS NOT NULL AND {_TWO} AND NOT contains(g, '.') AND {_DIFF}) AS h, count(*) FILTER (WHERE chrom = 'Y') AS y_variant_count FROM s GROUP BY 1),
sig AS (SELECT run_id, x_sites, CASE WHEN x_sites >= 20 THEN h / x_sites END AS x_het_ratio, y_variant_count,
  CASE WHEN x_sites < 20 THEN 'indeterminate' WHEN h / x_sites <= 0.1 THEN 'XY' WHEN h / x_sites >= 0.2 AND y_variant_count < 5 THEN 'XX' ELSE 'discordant' END AS inferred_sex FROM x)"""


@query("q_op_sex_inference", f"{SEX_SQL} SELECT * FROM sig")
def _(v, spark):
    return variants.sex_inference(v("calls_a"), "GRCh37", order=ORDER)


@query("q_op_sex_checks", f"""{SEX_SQL}
SELECT run_id, 'sex_plausibility' AS "check", CASE inferred_sex WHEN 'indeterminate' THEN 'unverified' WHEN 'discordant' THEN 'warn' ELSE 'pass' END AS status, CAST(NULL AS DOUBLE) AS value, false AS informational FROM sig
UNION ALL SELECT run_id, 'x_het_ratio', CASE WHEN x_het_ratio IS NULL THEN 'unverified' ELSE 'pass' END, x_het_ratio, true FROM sig""")
def _(v, spark):
    return variants.sex_checks(variants.sex_inference(v("calls_a"), "GRCh37", order=ORDER))


@query("q_op_par_mask", f"SELECT run_id, count(*) AS n FROM calls_a WHERE NOT ({_PAR37}) GROUP BY 1")
def _(v, spark):
    return variants.par_mask(v("calls_a"), "GRCh37").groupBy("run_id").agg(F.count("*").alias("n"))


COUNTS_SQL = """
WITH g AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.gene_id, b.gene_id) AS gene_id, a.count AS x, b.count AS y FROM counts_a a FULL JOIN counts_b b ON a.run_id = b.run_id AND a.gene_id = b.gene_id),
s AS (SELECT *, rank() OVER (PARTITION BY run_id ORDER BY x) + (count(*) OVER (PARTITION BY run_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY run_id ORDER BY y) + (count(*) OVER (PARTITION BY run_id, y) - 1) / 2 AS ry FROM g WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query("q_op_count_concordance", f"""{COUNTS_SQL},
r AS (SELECT run_id, count(*) AS shared, round(corr(rx, ry), 12) AS rho, count(*) FILTER (WHERE abs(x - y) / greatest(x, y, 1) <= 0.1) / count(*) AS fraction_agreeing FROM s GROUP BY 1),
u AS (SELECT run_id, count(*) AS n_union FROM g GROUP BY 1)
SELECT u.run_id, coalesce(shared, 0) AS shared, n_union, rho, fraction_agreeing, shared / n_union AS overlap,
  CASE WHEN shared < 10 OR rho IS NULL THEN 'unverified' WHEN rho < 0.9 THEN 'warn' ELSE 'pass' END AS rho_status, CASE WHEN shared < 10 OR fraction_agreeing IS NULL THEN 'unverified' WHEN fraction_agreeing < 0.9 THEN 'warn' ELSE 'pass' END AS agree_status
FROM u LEFT JOIN r USING (run_id)""")
def _(v, spark):
    return counts.count_concordance(v("counts_a"), v("counts_b"))


@query("q_w_avg_rank", f"{COUNTS_SQL} SELECT run_id, gene_id, rx AS avg_rank FROM s")
def _(v, spark):
    both = v("counts_a").join(v("counts_b").select("run_id", "gene_id"), ["run_id", "gene_id"])
    return counts.average_rank(both, "count", ["run_id"], "avg_rank").select("run_id", "gene_id", "avg_rank")


@query("q_op_collapse_to_gene", "SELECT run_id, gene_id, sum(est_counts) AS count FROM transcripts JOIN t2g USING (transcript_id) GROUP BY 1, 2")
def _(v, spark):
    return counts.collapse_to_gene(v("transcripts"), v("t2g"))


EVAL_SQL = f"""WITH j AS (SELECT m.run_id, m.sample, p."check" || ':' || m.sample AS "check", {BAND} AS status, value, {RANGE} AS expected_range, coalesce(fail_below, warn_below, warn_above, fail_above) IS NULL AS informational
FROM metrics m JOIN {pack_sql('rnaseq')} ON m.metric = p.metric)"""


@query("q_op_rule_eval", f"{EVAL_SQL} SELECT * FROM j")
def _(v, spark):
    return qc.rule_eval(v("metrics"), qc.rules(spark, "rnaseq"))


@query("q_op_rule_eval_required", f"""WITH s AS (SELECT DISTINCT run_id, sample FROM metrics)
SELECT s.run_id, s.sample, p."check" || ':' || s.sample AS "check", {BAND} AS status, value, {RANGE} AS expected_range, coalesce(fail_below, warn_below, warn_above, fail_above) IS NULL AS informational
FROM s CROSS JOIN {pack_sql('rnaseq')} LEFT JOIN metrics m ON m.run_id = s.run_id AND m.sample = s.sample AND m.metric = p.metric""")
def _(v, spark):
    m = v("metrics")
    return qc.rule_eval_required(m, m, qc.rules(spark, "rnaseq"))


_SEV = "CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END"
_NAME = "CASE {x} WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' WHEN 1 THEN 'pass' ELSE 'unverified' END"


@query("q_op_verdict", f"{EVAL_SQL} SELECT run_id, {_NAME.format(x=f'max({_SEV}) FILTER (WHERE NOT informational)')} AS verdict FROM j GROUP BY 1")
def _(v, spark):
    return qc.verdict(qc.rule_eval(v("metrics"), qc.rules(spark, "rnaseq")))


VERDICTS_SQL = f"vd AS (SELECT run_id, {_NAME.format(x=f'max({_SEV}) FILTER (WHERE NOT informational)')} AS verdict FROM checks GROUP BY 1)"
_FAILED = "coalesce(upper(status) = 'FAILED', false) OR coalesce(exit_code <> 0, false)"
RUN_VERDICT_SQL = f"""WITH {VERDICTS_SQL}, f AS (SELECT run_id, bool_or({_FAILED}) AS bad FROM tasks GROUP BY 1),
rv AS (SELECT run_id, CASE WHEN coalesce(bad, false) THEN 'fail' ELSE coalesce(verdict, 'unverified') END AS verdict FROM (SELECT DISTINCT run_id FROM runs) LEFT JOIN f USING (run_id) LEFT JOIN vd USING (run_id))"""


@query("q_op_run_verdict", f"{RUN_VERDICT_SQL} SELECT * FROM rv")
def _(v, spark):
    return qc.run_verdict(v("runs").select("run_id").distinct(), v("checks"), v("tasks"))


@query("q_op_list_runs", f"{RUN_VERDICT_SQL} SELECT run_id, verdict, CAST(CASE verdict WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 WHEN 'unverified' THEN 2 ELSE 3 END AS INT) AS sort_key FROM rv WHERE contains(run_id, 'u1')")
def _(v, spark):
    return qc.list_runs(qc.run_verdict(v("runs").select("run_id").distinct(), v("checks"), v("tasks")), "U1")


@query("q_op_run_summary", f"SELECT run_id, count(*) AS total, count(*) FILTER (WHERE {_FAILED}) AS failed, count(*) FILTER (WHERE NOT ({_FAILED})) AS succeeded FROM tasks GROUP BY 1")
def _(v, spark):
    return qc.run_summary(v("tasks"))


@query("q_op_qc_sorted", f'SELECT run_id, "check", status, CAST(row_number() OVER (PARTITION BY run_id ORDER BY {_SEV} DESC, "check") AS INT) AS place FROM checks')
def _(v, spark):
    return qc.sorted_checks(v("checks"))


@query("q_op_explain", f"""WITH {VERDICTS_SQL}, k AS (SELECT c.*, verdict FROM checks c JOIN vd USING (run_id) WHERE NOT informational)
SELECT run_id, verdict, count(*) AS total, count(*) FILTER (WHERE status = verdict) AS deciding, first("check" ORDER BY value, "check") FILTER (WHERE status = verdict) AS lowest,
  count(*) FILTER (WHERE status = verdict) || ' of ' || count(*) || ' checks are ' || verdict AS reason FROM k GROUP BY 1, 2""")
def _(v, spark):
    return qc.explain(v("checks"))


@query("q_w_deciding", f"""WITH {VERDICTS_SQL} SELECT run_id, first("check" ORDER BY value, "check") AS lowest FROM checks JOIN vd USING (run_id) WHERE NOT informational AND status = verdict GROUP BY 1""")
def _(v, spark):
    return qc.explain(v("checks")).select("run_id", "lowest")


@query("q_op_qc_anomaly", """SELECT run_id, 'qc_anomaly' AS failure_class, string_agg(DISTINCT "check", ',' ORDER BY "check") AS evidence FROM checks JOIN (SELECT DISTINCT run_id FROM runs WHERE status = 'succeeded') r USING (run_id) WHERE checks.status = 'fail' AND NOT informational GROUP BY 1""")
def _(v, spark):
    return qc.qc_anomaly(v("runs").select("run_id", "status").distinct(), v("checks"))


@query("q_op_library_skew", """WITH a AS (SELECT run_id, max(value) AS hi, min(value) AS lo FROM metrics WHERE metric = 'library_size' GROUP BY 1 HAVING count(*) >= 2)
SELECT run_id, 'library_size_skew' AS "check", CASE WHEN hi / lo >= 10 THEN 'fail' WHEN hi / lo >= 3 THEN 'warn' ELSE 'pass' END AS status, hi / lo AS value FROM a""")
def _(v, spark):
    return qc.library_skew(v("metrics"), "library_size")


@query("q_op_min_samples", "SELECT run_id, count(DISTINCT regexp_replace(sample, ' Read [0-9]+$', '')) AS n_samples, CASE WHEN count(DISTINCT regexp_replace(sample, ' Read [0-9]+$', '')) < 2 THEN 'fail' ELSE 'pass' END AS status FROM metrics GROUP BY 1")
def _(v, spark):
    return qc.min_samples(v("metrics"))


@query("q_op_mad_outliers", """WITH o AS (SELECT run_id, sample, value FROM metrics WHERE metric = 'library_size'), m AS (SELECT run_id, median(value) AS med FROM o GROUP BY 1 HAVING count(*) >= 3),
d AS (SELECT o.*, abs(value - med) AS dev FROM o JOIN m USING (run_id)), k AS (SELECT run_id, median(dev) AS mad FROM d GROUP BY 1 HAVING median(dev) > 0)
SELECT run_id, sample, 'warn' AS status, value, dev / mad AS score FROM d JOIN k USING (run_id) WHERE dev / mad > 1.5""")
def _(v, spark):
    return qc.mad_outliers(v("metrics"), "library_size", threshold=1.5)


@query("q_op_capture_inputs", "SELECT run_id, CAST(count(DISTINCT family) AS INT) AS families, round(sum(value), 4) AS total FROM metrics GROUP BY 1")
def _(v, spark):
    nested = qc.captured_inputs(v("metrics"))
    flat = nested.select("run_id", F.size("verification_inputs").alias("families"), F.explode("verification_inputs").alias("family", "s")).select("run_id", "families", F.explode("s").alias("sample", "m")).select("run_id", "families", F.explode("m").alias("metric", "value"))
    return flat.groupBy("run_id", "families").agg(F.round(F.sum("value"), 4).alias("total"))


COST = "realtime_sec / 3600 * pct_cpu / 100 * 0.05 + realtime_sec / 3600 * peak_rss_mb / 1024 * 0.005"


@query("q_op_cost", f"SELECT run_id, process, round(sum({COST}), 6) AS cost, count(*) AS n_tasks FROM tasks GROUP BY ROLLUP (run_id, process)")
def _(v, spark):
    return repair.cost(v("tasks")).withColumn("cost", F.round("cost", 6))


@query("q_op_estimate", """WITH h AS (SELECT pipeline, avg(runtime_sec / n_samples) AS sec, max(peak_mb) AS mb FROM history WHERE status = 'succeeded' AND n_samples > 0 GROUP BY 1)
SELECT request_id, pipeline, round(coalesce(sec, 600) * n_samples, 4) AS runtime_sec, coalesce(mb, 2048.0 * n_samples) AS memory_mb, CASE WHEN sec IS NULL THEN 'heuristic' ELSE 'history' END AS basis FROM requests LEFT JOIN h USING (pipeline)""")
def _(v, spark):
    return repair.estimate(v("requests"), v("history")).withColumn("runtime_sec", F.round("runtime_sec", 4))


@query("q_op_size_retry", """WITH o AS (SELECT DISTINCT run_id, process FROM tasks WHERE exit_code = 137), m AS (SELECT run_id, max(peak_rss_mb) AS mb FROM tasks SEMI JOIN o USING (run_id, process) GROUP BY 1), t AS (SELECT run_id, max(realtime_sec) AS sec FROM tasks GROUP BY 1)
SELECT run_id, CAST(ceil(mb / 1024 * 1.5) AS BIGINT) AS target_gb, CAST(ceil(sec / 3600 * 1.5) AS BIGINT) AS target_h FROM t LEFT JOIN m USING (run_id)""")
def _(v, spark):
    return repair.size_retry(v("tasks"))


@query("q_op_apply_ceiling", "SELECT run_id, greatest(least(coalesce(target_gb, 16), 128), 8) AS memory_gb, greatest(least(greatest(coalesce(target_h, 0), 8), 72), 4) AS time_h FROM sizes")
def _(v, spark):
    return repair.apply_ceiling(v("sizes"))


@query("q_op_repair_policy", f"""WITH d AS (SELECT run_id, any_value(failure_class) AS failure_class, CASE WHEN any_value(failure_class) = 'tool_crash' THEN 0.4 ELSE 0.9 END AS confidence FROM steps GROUP BY 1),
p AS (SELECT * FROM (VALUES {', '.join(str(r) for r in T.REPAIRS)}) AS p(failure_class, kind, operation, risk))
SELECT d.failure_class, run_id, CAST(confidence AS DOUBLE) AS confidence, kind, operation, risk, confidence < 0.5 AS ambiguous FROM d JOIN p USING (failure_class)""")
def _(v, spark):
    d = v("steps").groupBy("run_id").agg(F.any_value("failure_class").alias("failure_class"))
    d = d.withColumn("confidence", F.when(F.col("failure_class") == "tool_crash", 0.4).otherwise(0.9))
    return repair.repair_policy(d, repair.policy(spark))


@query("q_op_repair_stats", """WITH r AS (SELECT run_id, failure_class, bool_or(patch_applied) AS p, bool_or(outcome = 'succeeded') AS ok FROM steps GROUP BY 1, 2)
SELECT failure_class, count(*) AS runs, count(*) FILTER (WHERE p AND ok) AS recovered FROM r GROUP BY 1""")
def _(v, spark):
    return repair.repair_stats(v("steps"))
