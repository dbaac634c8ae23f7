"""Queries over the column expressions, sinks and streams that larger operators are made of, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as T
from ..operators import annotations, references, variants
from ..sources import readers, sinks
from ..streaming import streams
from . import more, texts  # noqa: F401  have views that are used here
from .core import BAND, GT_SQL, RUN_VERDICT_SQL, VERDICTS_SQL, _FAILED, qc, query, sites
from .files import _symbol_sql, _term_sql, folder, spread, traces, write
from .views import VIEWS


@query("q_fn_normalize_gt", f"SELECT run_id, gt, {GT_SQL} AS g, count(*) AS n FROM calls_b GROUP BY ALL")
def _(v, spark):
    return v("calls_b").groupBy("run_id", "gt", S.normalize_gt(F.col("gt")).alias("g")).agg(F.count("*").alias("n"))


@query("q_fn_chrom_is", "SELECT run_id, chrom, regexp_replace(lower(chrom), '^chr', '') = 'x' AS is_x, regexp_replace(lower(chrom), '^chr', '') = 'y' AS is_y, count(*) AS n FROM calls_a GROUP BY ALL")
def _(v, spark):
    return v("calls_a").groupBy("run_id", "chrom", *[S.chrom_is(F.col("chrom"), c).alias(f"is_{c}") for c in "xy"]).agg(F.count("*").alias("n"))


_SNV = "ref IN ('A', 'C', 'G', 'T') AND alt IN ('A', 'C', 'G', 'T')"
VIEWS["alleles"] = "SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS run_id, substr('ACGTa', CAST(l_partkey % 5 AS INT) + 1, 1) AS ref, substr('ACGTN*', CAST(l_orderkey % 6 AS INT) + 1, CASE WHEN l_linenumber = 7 THEN 2 ELSE 1 END) AS alt FROM lineitem"


@query("q_fn_transition", f"SELECT run_id, ref, alt, {_SNV} AS snv, ref || alt IN ('AG', 'GA', 'CT', 'TC') AS transition, count(*) AS n FROM alleles GROUP BY ALL")
def _(v, spark):
    """Equal alleles, lower case, other letters and longer alleles included."""
    ref, alt = F.col("ref"), F.col("alt")
    return v("alleles").groupBy("run_id", "ref", "alt", S.biallelic_snv(ref, alt).alias("snv"), S.transition(ref, alt).alias("transition")).agg(F.count("*").alias("n"))


@query("q_fn_severity_rank", f"""WITH t AS (SELECT run_id, unnest(string_split(ann, ',')) AS t FROM ann_a), w AS (SELECT run_id, lower(trim(unnest(string_split(split_part(t, '|', 2), '&')))) AS term FROM t)
SELECT run_id, term, coalesce(list_position({T.SEVERITY}, term) - 1, 1) AS severity, count(*) AS n FROM w WHERE term <> '' GROUP BY ALL""")
def _(v, spark):
    terms = v("ann_a").select("run_id", F.explode(S.variant_terms(F.col("ann"), F.lit(1))).alias("term"))
    return terms.groupBy("run_id", "term", S.severity_rank(F.col("term")).alias("severity")).agg(F.count("*").alias("n"))


VIEWS["bounds"] = "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS fb, CASE WHEN p_size % 3 = 0 THEN p_size + 0.5e0 END AS wb, CASE WHEN p_size % 5 = 0 THEN p_size + 100.25e0 END AS wa, CASE WHEN p_size % 7 = 0 THEN p_size + 200e0 END AS fa FROM part"


@query("q_fn_expected_range", """WITH b AS (SELECT *, CAST(CAST(coalesce(wb, fb) AS DECIMAL(18, 2)) AS VARCHAR) AS lo, CAST(CAST(coalesce(wa, fa) AS DECIMAL(18, 2)) AS VARCHAR) AS hi FROM bounds)
SELECT p_partkey, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN '[' || lo || ', ' || hi || ']' WHEN lo IS NOT NULL THEN '>= ' || lo WHEN hi IS NOT NULL THEN '<= ' || hi END AS expected, lo IS NULL AND hi IS NULL AS informational FROM b""")
def _(v, spark):
    edges = [F.col(c) for c in ("fb", "wb", "wa", "fa")]
    return v("bounds").select("p_partkey", S.expected_range(*edges).alias("expected"), S.band_less(*edges).alias("informational"))


@query("q_fn_duration_sec", """SELECT task_id, CASE WHEN task_id % 11 = 0 THEN 0.0 ELSE (task_id % 5) * 3600.0 + (task_id % 60) * 60.0 + (task_id % 40) / 4.0 END AS sec,
CASE task_id % 6 WHEN 0 THEN (task_id % 90) / 1048576.0 WHEN 1 THEN (task_id % 90) / 1024.0 WHEN 2 THEN (task_id % 90) * 1.0 WHEN 3 THEN (task_id % 90) * 1024.0 WHEN 4 THEN (task_id % 90) * 1048576.0 ELSE 0.0 END AS mb, CASE WHEN task_id % 11 = 0 THEN 0.0 ELSE (task_id % 800) / 10.0 END AS cpu FROM tasks""")
def _(v, spark):
    """Durations, sizes and shares as a trace writes them, '-' where nothing was measured."""
    i = F.col("task_id")
    took = F.concat(i % 5, F.lit("h "), i % 60, F.lit("m "), (i % 40) / 4, F.lit("s"))
    size = F.concat_ws(" ", (i % 90).cast("string"), F.get(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "-")]), (i % 6).cast("int")))
    share = F.concat((i % 800) / 10, F.lit("%"))
    blank = lambda c: F.when(i % 11 == 0, "-").otherwise(c)
    return v("tasks").select("task_id", S.duration_sec(blank(took)).alias("sec"), S.size_mb(size).alias("mb"), S.pct_cpu(blank(share)).alias("cpu"))


@query("q_src_somatic_sheet", "SELECT patient, sample, status, nullif(fastq_1, '') AS fastq_1, fastq_2, 'auto' AS strandedness FROM sheets")
def _(v, spark):
    """Rows of somatic sheets: tumour and normal samples of a patient, empty cells as NULL."""
    cells = ["patient", "sample", "status", "fastq_1", "fastq_2"]
    s = v("sheets").withColumn("run_id", F.concat(F.lit("r"), F.pmod(F.col("patient").cast("long"), F.lit(20))))
    return readers.samplesheet(spark, spread(s, cells, [F.col(c) for c in cells], "patient", ",")).select(*cells, "strandedness")


@query("q_fn_vaf_mutect", "SELECT run_id, CASE WHEN vaf IS NOT NULL THEN q / 50 END AS vaf, count(*) AS n FROM vafs GROUP BY ALL")
def _(v, spark):
    """Half of the records have a malformed AF, so AD and DP count; those without a share have a depth of 0."""
    af = F.when(F.col("vaf").isNull() | (F.col("k") % 2 == 0), "x").otherwise((F.col("q") / 50).cast("string"))
    text = F.concat(F.lit("0/1:3,"), F.col("q").cast("int"), F.lit(":"), af, F.lit(":"), F.when(F.col("vaf").isNull(), "0").otherwise("50"))
    return v("vafs").groupBy("run_id", S.vaf_mutect(F.lit("GT:AD:AF:DP"), text).alias("vaf")).agg(F.count("*").alias("n"))


@query("q_fn_variant_terms", """WITH t AS (SELECT run_id, unnest(string_split(ann, ',')) AS t FROM ann_a), w AS (SELECT run_id, lower(trim(unnest(string_split(split_part(t, '|', 2), '&')))) AS term FROM t)
SELECT run_id, term, count(*) AS n FROM w WHERE term <> '' GROUP BY ALL""")
def _(v, spark):
    return v("ann_a").select("run_id", F.explode(S.variant_terms(F.col("ann"), F.lit(1))).alias("term")).groupBy("run_id", "term").agg(F.count("*").alias("n"))


@query("q_fn_symbol", "SELECT run_id, nullif(nullif(lower(trim(split_part(split_part(ann, ',', 1), '|', 3))), ''), '.') AS symbol, count(*) AS n FROM ann_b GROUP BY ALL")
def _(v, spark):
    return v("ann_b").groupBy("run_id", S.symbol(F.col("ann"), F.lit(2)).alias("symbol")).agg(F.count("*").alias("n"))


@query("q_fn_band_status", f"SELECT run_id, sample, metric, {BAND} AS status FROM (SELECT *, 30.0 AS fail_below, 55.0 AS warn_below, 62.0 AS warn_above, 70.0 AS fail_above FROM metrics)")
def _(v, spark):
    return v("metrics").select("run_id", "sample", "metric", S.band_status(F.col("value"), *[F.lit(x) for x in (30.0, 55.0, 62.0, 70.0)]).alias("status"))


@query("q_fn_unit_refusal", "SELECT run_id, sample, metric, metric <> 'library_size' AND NOT (value / 50 BETWEEN 0 AND 1) AS refused FROM metrics")
def _(v, spark):
    unit = F.when(F.col("metric") != "library_size", "fraction").otherwise("count")
    return v("metrics").select("run_id", "sample", "metric", S.unit_refused(unit, F.col("value") / 50).alias("refused"))


@query("q_fn_task_failed", f"SELECT run_id, task_id, {_FAILED} AS failed FROM tasks")
def _(v, spark):
    return v("tasks").select("run_id", "task_id", S.task_failed(F.col("status"), F.col("exit_code")).alias("failed"))


@query("q_fn_relative_delta", "SELECT p_partkey, CASE WHEN p_size = 10 THEN abs(CAST(p_partkey % 7 AS DOUBLE)) ELSE abs(CAST(p_partkey % 7 - (p_size - 10) AS DOUBLE)) / abs(CAST(p_size - 10 AS DOUBLE)) END AS delta FROM parts")
def _(v, spark):
    return v("parts").select("p_partkey", S.relative_delta((F.col("p_partkey") % 7).cast("double"), (F.col("p_size") - 10).cast("double")).alias("delta"))


@query("q_fn_concordance_status", """WITH r AS (SELECT run_id, process, count(*) AS n, avg(CASE WHEN exit_code = 0 THEN 1.0 ELSE 0.0 END) AS value FROM tasks GROUP BY ALL)
SELECT run_id, process, CASE WHEN n < 45 THEN 'unverified' WHEN value < 0.9 THEN 'warn' ELSE 'pass' END AS status FROM r""")
def _(v, spark):
    r = v("tasks").groupBy("run_id", "process").agg(F.count("*").alias("n"), F.avg(F.when(F.col("exit_code") == 0, 1.0).otherwise(0.0)).alias("value"))
    return r.select("run_id", "process", S.concordance_status(F.col("value"), F.col("n"), F.lit(45)).alias("status"))


@query("q_fn_source_kind", "SELECT split_part(source, ':', 1) AS kind, expected, count(*) AS n FROM cases GROUP BY ALL")
def _(v, spark):
    return v("cases").groupBy(S.source_kind(F.col("source")).alias("kind"), "expected").agg(F.count("*").alias("n"))


@query("q_fn_canonical_sha", """SELECT claim_id, sha256('{"claim_id":"' || claim_id || '","family":"' || family || '","run_id":"' || run_id || '"}') AS sha FROM paper_claims""")
def _(v, spark):
    return v("paper_claims").select("claim_id", S.canonical_sha("run_id", "family", "claim_id").alias("sha"))


@query("q_w_last_wins", f"SELECT run_id, chrom, count(*) AS n_sites, count(*) FILTER (WHERE g = '1/1') AS hom FROM ({sites('calls_b')}) GROUP BY 1, 2")
def _(v, spark):
    s = variants._sites(v("calls_b"), ["run_id"], ["o1", "o2", "o3"])
    return s.groupBy("run_id", "chrom").agg(F.count("*").alias("n_sites"), F.count_if(F.col("g") == "1/1").alias("hom"))


_FIRST = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(goal), '{p}')''' for p in ps)} THEN {i}" for i, (_, ps) in enumerate(T.ASSAYS)) + " ELSE -1 END"


@query("q_w_first_match", f"SELECT goal_id, CAST({_FIRST} AS INT) AS rule FROM goals")
def _(v, spark):
    """Number of the first rule that fires, from an array of candidates: no join and no shuffle."""
    low = F.lower("goal")
    fires = F.array(*[F.struct(F.lit(i).alias("rule"), F.greatest(F.lit(False), *[F.contains(low, F.lit(p)) for p in ps]).alias("hit")) for i, (_, ps) in enumerate(T.ASSAYS)])
    return v("goals").select("goal_id", F.coalesce(F.get(F.filter(fires, lambda x: x["hit"]), F.lit(0))["rule"], F.lit(-1)).alias("rule"))


VIEWS["alias_pairs"] = "SELECT 'n' || CAST(c_nationkey AS STRING) AS a, CASE WHEN c_custkey % 40 = 0 THEN 'm3' ELSE 'm' || CAST(c_nationkey AS STRING) END AS b FROM customer"


@query("q_op_alias_table", """WITH p AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM alias_pairs WHERE a <> b), r AS (SELECT DISTINCT unnest([a, b]) AS name, a AS grp FROM p), c AS (SELECT name, count(DISTINCT grp) AS n, min(grp) AS grp FROM r GROUP BY 1)
SELECT name, CASE WHEN n = 1 THEN grp END AS grp, n > 1 AS conflict FROM c""")
def _(v, spark):
    good, bad = references.alias_table(v("alias_pairs"))
    return good.select("name", "grp", F.lit(False).alias("conflict")).unionByName(bad.select("name", F.lit(None).cast("string").alias("grp"), F.lit(True).alias("conflict")))


@query("q_op_capture_gate", f"WITH {VERDICTS_SQL} SELECT DISTINCT run_id, assay, verdict FROM runs JOIN vd USING (run_id) WHERE status = 'succeeded' AND verdict IN ('fail', 'warn')")
def _(v, spark):
    from ..operators import corpus

    return corpus.capture_gate(v("runs").select("run_id", "assay", "status").distinct(), qc.verdict(v("checks")), ["run_id"]).join(v("runs").select("run_id", "assay").distinct(), "run_id").select("run_id", "assay", "verdict")


@query("q_src_trace_usage", "SELECT run_id, process, round(sum(realtime_sec), 2) AS sec, max(peak_rss_mb) AS most_mb, sum(pct_cpu) AS cpu FROM tasks GROUP BY 1, 2")
def _(v, spark):
    return readers.trace(spark, traces(v("tasks"))).groupBy("run_id", "process").agg(F.round(F.sum("realtime_sec"), 2).alias("sec"), F.max("peak_rss_mb").alias("most_mb"), F.sum("pct_cpu").alias("cpu"))


@query("q_src_jsonl_strict", "SELECT run_id, status, count(*) AS n, max(task_id) AS last_id FROM tasks GROUP BY 1, 2")
def _(v, spark):
    at = folder(spark)
    v("tasks").select("run_id", "task_id", "status").write.json(at)
    return readers.jsonl(spark, at, "run_id string, task_id long, status string", ["task_id"], strict=True).groupBy("run_id", "status").agg(F.count("*").alias("n"), F.max("task_id").alias("last_id"))


@query("q_snk_records", f"{RUN_VERDICT_SQL} SELECT run_id, assay, status, verdict FROM (SELECT DISTINCT run_id, assay, status FROM runs) r JOIN rv USING (run_id)")
def _(v, spark):
    r = v("runs").select("run_id", "assay", "status").distinct()
    at = folder(spark)
    sinks.write_records(r.join(qc.run_verdict(r.select("run_id").distinct(), v("checks"), v("tasks")), "run_id"), at)
    return spark.read.schema("run_id string, assay string, status string, verdict string").json(at, recursiveFileLookup=True)


@query("q_src_runs", "SELECT DISTINCT run_id, assay, status FROM runs")
def _(v, spark):
    """A bundle for each run, of which the reader takes whatever file has the name it is told."""
    at = folder(spark)
    sinks.write_records(v("runs").select("run_id", "assay", "status").distinct(), at)
    return readers.runs(spark, at, name="part-*.json").select("run_id", "assay", "status")


@query("q_op_corroboration_line", f"""WITH i AS (SELECT run_id, string_agg(DISTINCT CASE WHEN line LIKE '##VEP%' THEN 'VEP' ELSE 'SnpEff' END, ' and ' ORDER BY CASE WHEN line LIKE '##VEP%' THEN 'VEP' ELSE 'SnpEff' END) AS names FROM ann_headers WHERE line LIKE '##VEP%' OR line LIKE '##Snp%' GROUP BY 1),
c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE a.term = b.term) AS m FROM ({_term_sql('ann_a')}) a JOIN ({_term_sql('ann_b')}) b USING (run_id, chrom, pos, ref, alt) GROUP BY 1),
s AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE a.symbol = b.symbol) AS m FROM ({_symbol_sql('ann_a')}) a JOIN ({_symbol_sql('ann_b')}) b USING (run_id, chrom, pos, ref, alt) WHERE a.symbol IS NOT NULL AND b.symbol IS NOT NULL GROUP BY 1)
SELECT c.run_id, 'Corroborated by ' || coalesce(names, 'the two annotators') || printf(': %d/%d consequences agree (%.2f)', c.m, c.n, c.m / c.n) || CASE WHEN s.n > 0 THEN printf('; gene symbols %d/%d (%.2f, informational)', s.m, s.n, s.m / s.n) ELSE '' END || '.' AS line
FROM c LEFT JOIN s USING (run_id) LEFT JOIN i USING (run_id)""")
def _(v, spark):
    a, b = (v(n).withColumn("idx", F.lit(1)).withColumn("sym_idx", F.lit(2)) for n in ("ann_a", "ann_b"))
    order = ["o1", "o2", "o3"]
    return annotations.corroboration_line(annotations.consequence_concordance(a, b, order=order), annotations.symbol_concordance(a, b, order=order), annotations.annotation_identity(v("ann_headers")))


@query("q_snk_snapshot_append", "SELECT metric, count(*) AS n, max(value) AS most, count(DISTINCT ts) AS n_ts FROM snapshots GROUP BY 1")
def _(v, spark):
    s, at = v("snapshots"), folder(spark)
    for part in (F.col("ts") < "1995-01-01", F.col("ts") >= "1995-01-01"):
        sinks.append_snapshot(s.where(part), at)
    back = spark.read.schema("metric string, ts timestamp, value double, detector string").json(at)
    return back.groupBy("metric").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.count_distinct("ts").alias("n_ts"))


@query("q_snk_gtf", "SELECT run_id, name || chr(9) || 'exon' AS line FROM (SELECT DISTINCT run_id, name FROM gtf_names)")
def _(v, spark):
    names, at = v("gtf_names").distinct(), folder(spark)
    sinks.write_gtf(names.select("run_id", F.hash("name").alias("line_no"), F.concat("name", F.lit("\texon")).alias("line")), at)
    return readers._text(spark, at).select("run_id", F.col("value").alias("line"))


@query("q_st_trace_ingest", "SELECT run_id, count(*) AS n, max(task_id) AS last_id FROM tasks WHERE task_id % 7 <> 0 GROUP BY 1")
def _(v, spark):
    """A stream over JSON lines, of which one in seven is cut off, run until it has caught up."""
    t = v("tasks")
    body = F.to_json(F.struct("run_id", "task_id"))
    at = write(t.select("run_id", F.col("task_id").alias("n"), F.when(F.col("task_id") % 7 == 0, F.substring(body, 1, 15)).otherwise(body).alias("value")))
    out = folder(spark)
    tail = streams.json_tail(spark, f"{at}/*", "run_id string, task_id long", "task_id")
    tail.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}-log").format("parquet").start(out).awaitTermination()
    return spark.read.schema("run_id string, task_id long").parquet(out).groupBy("run_id").agg(F.count("*").alias("n"), F.max("task_id").alias("last_id"))


@query("q_st_capture", f"WITH {VERDICTS_SQL} SELECT run_id, verdict FROM vd WHERE verdict IN ('fail', 'warn')")
def _(v, spark):
    """Finished runs arrive as a stream, and again after a restart; each bad one is captured once."""
    at, out = folder(spark), folder(spark)
    qc.verdict(v("checks")).select("run_id", "verdict").write.parquet(at)
    for log in ("first", "again"):
        finished = spark.readStream.schema("run_id string, verdict string").parquet(at)
        streams.capture(finished, out, f"{out}-{log}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("run_id string, verdict string").parquet(out)
