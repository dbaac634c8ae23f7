"""Queries over files: Spark writes the views in the formats that runs leave, and the readers read them back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotations, variants
from ..sources import readers
from ..streaming import live, streams
from .core import query, sites
from .views import VIEWS

_OWN: list[str] = []
#: Files of a run that ``spread`` and ``_vcf`` write at least into, and rows for which there is one more, so that no task holds a whole run.
FILES, FILE_ROWS = 16, 500_000


def folder(spark) -> str:
    """A new folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="cohortlens-files-"))
        found = _OWN[0]
    return f"{found.rstrip('/')}/files-{uuid.uuid4().hex}/runs"


def staged(df: DataFrame) -> DataFrame:
    """Rows written once to a new folder, for plans that take them many times; such a plan would hold, and run, all that is behind them as often."""
    at = folder(df.sparkSession) + ".parquet"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def write(lines: DataFrame, extension: str = "txt", at: str | None = None) -> str:
    """Lines (run_id, n, value) as one text file for each run, in order of n, in a new folder or added to one."""
    at = at or folder(lines.sparkSession)
    rows = lines.repartition("run_id").sortWithinPartitions("run_id", "n").select("run_id", "value").write.mode("append").partitionBy("run_id")
    if extension == "txt":
        rows.text(at)
    else:  # text files take no extension; the separator stands in no line
        rows.option("extension", extension).csv(at, sep="\x01", quote="", emptyValue="")
    return at


def pack(lines: DataFrame, name: str = "report.txt") -> str:
    """Lines (run_id, n, value) as one small file for each run, held as rows of one table (``archives.packed``).

    For reports of a few lines of any number of runs: a file of its own for each would cost some 17 ms of a task to write, and more to list and open.
    """
    at = folder(lines.sparkSession) + ".parquet"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("value", F.lit("")).alias("value")))), lambda x: x["value"])
    files = lines.groupBy("run_id").agg(F.concat(F.array_join(ordered, "\n"), F.lit("\n")).cast("binary").alias("content"))
    path = F.concat(F.lit("/runs/run_id="), "run_id", F.lit(f"/{name}"))
    files.select(path.alias("path"), F.current_timestamp().alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content").write.parquet(at)
    return at


def n_files(df: DataFrame) -> int:
    """Files of each run, so that even a run with all rows has about FILE_ROWS in a file."""
    return max(FILES, -(-df.count() // FILE_ROWS))


def spread(df: DataFrame, header: list[str], columns: list, by: str, sep: str = "\t") -> str:
    """Rows as several files for each run, each with a header line; rows of one ``by`` are in one file."""
    at = folder(df.sparkSession)
    cells = [F.coalesce(c.cast("string"), F.lit("-")).alias(h) for h, c in zip(header, columns, strict=True)]
    rows = df.select(F.col("run_id").alias("run_id"), *cells, F.pmod(F.xxhash64(by), F.lit(n_files(df))).alias("__file"))
    rows.repartition("run_id", "__file").drop("__file").write.partitionBy("run_id").csv(at, header=True, sep=sep, quote="", emptyValue="")
    return at


def tsv(df: DataFrame, header: list[str], columns: list, sep: str = "\t", to=write) -> str:
    """Rows with a header line at the top of each run's file."""
    top = df.select("run_id").distinct().select("run_id", F.lit(-1).cast("long").alias("n"), F.lit(sep.join(header)).alias("value"))
    cells = [F.coalesce(c.cast("string"), F.lit("-")) for c in columns]
    rows = df.select("run_id", F.monotonically_increasing_id().alias("n"), F.concat_ws(sep, *cells).alias("value"))
    return to(top.unionByName(rows))


_HEADER = ["##fileformat=VCFv4.2", "##contig=<ID=chrX,length=155270560>", '##INFO=<ID=CSQ,Number=.,Type=String,Description="Format: Allele|Consequence|SYMBOL">', "##GATKCommandLine=<ID=Mutect2,CommandLine=\"--panel-of-normals pon.vcf\">", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1"]


def _vcf(calls: DataFrame, info=None) -> str:
    """Calls as several files for each run, each with the header; rows of one site are in one file, in their order, so no task holds a run."""
    info = F.lit(".") if info is None else info
    body = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", "alt", F.lit("50"), "filter", info, F.lit("DP:GT"), F.concat(F.lit("9:"), "gt"))
    shard = F.pmod(F.xxhash64("chrom", "pos", "ref", "alt"), F.lit(n_files(calls))).alias("shard")
    rows = calls.select("run_id", shard, F.lit(0).alias("n"), "o1", "o2", "o3", body.alias("value"))
    lines = F.explode(F.array(*[F.struct(F.lit(i - len(_HEADER)).alias("n"), F.lit(x).alias("value")) for i, x in enumerate(_HEADER)])).alias("h")
    head = calls.select("run_id", shard).distinct().select("run_id", "shard", lines).select("run_id", "shard", "h.*")
    at = folder(calls.sparkSession)
    both = rows.unionByName(head, allowMissingColumns=True).repartition("run_id", "shard").sortWithinPartitions("run_id", "shard", "n", "o1", "o2", "o3")
    both.select("run_id", "shard", "value").write.partitionBy("run_id", "shard").text(at)
    return at


@query("q_src_vcf", f"SELECT run_id, count(*) AS n_sites, count(*) FILTER (WHERE g IS NOT NULL) AS called, count(*) FILTER (WHERE g = '0/1') AS het FROM ({sites('calls_a')}) GROUP BY 1")
def _(v, spark):
    read = readers.vcf(spark, _vcf(v("calls_a")))
    s = variants._sites(read, ["run_id"], ["line"])
    return s.groupBy("run_id").agg(F.count("*").alias("n_sites"), F.count_if(F.col("g").isNotNull()).alias("called"), F.count_if(F.col("g") == "0/1").alias("het"))


@query("q_src_vcf_pass", "SELECT run_id, count(*) AS n FROM (SELECT DISTINCT run_id, chrom, pos, ref, alt FROM calls_b WHERE filter IN ('PASS', '.')) GROUP BY 1")
def _(v, spark):
    return readers.vcf_pass(spark, _vcf(v("calls_b"))).groupBy("run_id").agg(F.count("*").alias("n"))


@query("q_src_vcf_header", "SELECT DISTINCT run_id, 'GRCh37' AS build, true AS has_csq, false AS has_ann, 1 AS consequence_at, 2 AS symbol_at, 1 AS n_gatk FROM calls_a")
def _(v, spark):
    h = readers.vcf_header(spark, _vcf(v("calls_a")))
    return h.select("run_id", "build", "has_csq", "has_ann", F.col("consequence_at").cast("int").alias("consequence_at"), F.col("symbol_at").cast("int").alias("symbol_at"), F.size("gatk").alias("n_gatk")).distinct()


@query("q_op_pon_applied", "SELECT DISTINCT run_id, 'pass' AS status FROM calls_a")
def _(v, spark):
    lines = readers._text(spark, _vcf(v("calls_a"))).select("run_id", F.col("value").alias("line"))
    return variants.pon_applied(lines)


VIEWS["ann_a"] = "SELECT calls.*, CASE pos / 400 % 5 WHEN 0 THEN 'A|intergenic_variant|' WHEN 1 THEN 'A|Missense_variant&splice_region_variant|TP53,A|intron_variant|X' WHEN 2 THEN 'A|3_prime_UTR_variant|brca' WHEN 3 THEN '' ELSE 'A|stop_gained|KRAS' END AS ann FROM (" + VIEWS["calls_a"] + ") calls"
VIEWS["ann_b"] = "SELECT calls.*, CASE WHEN o1 = 3 THEN 'A|intron_variant|kras' ELSE CASE pos / 400 % 5 WHEN 0 THEN 'A|intergenic_variant|' WHEN 1 THEN 'A|missense_variant|tp53' WHEN 2 THEN 'A|stop_lost|BRCA2' WHEN 3 THEN '' ELSE 'A|stop_gained|KRAS' END END AS ann FROM (" + VIEWS["calls_b"] + ") calls"
for _n in ("ann_a", "ann_b"):
    VIEWS[_n] = VIEWS[_n].replace("pos / 400 % 5", "o_key % 5").replace("l_linenumber AS o1", "l_orderkey AS o_key, l_linenumber AS o1")


def _term_sql(view: str) -> str:
    """Each site's most severe term, of the last row that has any."""
    return f"""SELECT run_id, chrom, pos, ref, alt, last(term ORDER BY o1, o2, o3) AS term FROM (SELECT *, CASE WHEN ann LIKE '%Missense%' OR ann LIKE '%|missense%' THEN 'missense_variant' WHEN ann = '' THEN NULL ELSE lower(split_part(ann, '|', 2)) END AS term FROM {view}) WHERE term IS NOT NULL GROUP BY ALL"""


@query("q_op_consequence_concordance", f"""WITH j AS (SELECT run_id, a.term AS x, b.term AS y FROM ({_term_sql('ann_a')}) a JOIN ({_term_sql('ann_b')}) b USING (run_id, chrom, pos, ref, alt)), r AS (SELECT run_id, count(*) AS shared, count(*) FILTER (WHERE x = y) AS matches FROM j GROUP BY 1)
SELECT *, matches / shared AS agreement, CASE WHEN shared < 10 THEN 'unverified' WHEN matches / shared < 0.9 THEN 'warn' ELSE 'pass' END AS status, false AS informational FROM r""")
def _(v, spark):
    side = lambda n: v(n).withColumn("idx", F.lit(1))
    return annotations.consequence_concordance(side("ann_a"), side("ann_b"), order=["o1", "o2", "o3"])


def _symbol_sql(view: str) -> str:
    return f"SELECT run_id, chrom, pos, ref, alt, last(nullif(lower(split_part(split_part(ann, ',', 1), '|', 3)), '') ORDER BY o1, o2, o3) AS symbol FROM {view} GROUP BY ALL"


@query("q_op_symbol_concordance", f"""WITH j AS (SELECT run_id, a.symbol AS x, b.symbol AS y FROM ({_symbol_sql('ann_a')}) a JOIN ({_symbol_sql('ann_b')}) b USING (run_id, chrom, pos, ref, alt) WHERE a.symbol IS NOT NULL AND b.symbol IS NOT NULL), r AS (SELECT run_id, count(*) AS shared, count(*) FILTER (WHERE x = y) AS matches FROM j GROUP BY 1)
SELECT *, matches / shared AS agreement, CASE WHEN shared < 10 THEN 'unverified' ELSE 'pass' END AS status, true AS informational FROM r""")
def _(v, spark):
    side = lambda n: v(n).withColumn("sym_idx", F.lit(2))
    return annotations.symbol_concordance(side("ann_a"), side("ann_b"), order=["o1", "o2", "o3"])


@query("q_op_annotation_structural", "SELECT run_id, count(*) AS total, count(*) FILTER (WHERE ann <> '') AS annotated, count(*) FILTER (WHERE ann <> '') / count(*) AS value, CASE WHEN count(*) FILTER (WHERE ann <> '') = count(*) THEN 'pass' ELSE 'warn' END AS status FROM ann_a GROUP BY 1")
def _(v, spark):
    return annotations.annotation_structural(v("ann_a"))


@query("q_op_annotation_plausibility", "SELECT run_id, count(*) FILTER (WHERE ann NOT LIKE '%intergenic%') / count(*) AS real_consequence_fraction, count(*) FILTER (WHERE ann LIKE '%intergenic%') / count(*) AS intergenic_fraction FROM ann_a WHERE ann <> '' GROUP BY 1")
def _(v, spark):
    return annotations.annotation_metrics(v("ann_a").withColumn("idx", F.lit(1)))


VIEWS["vafs"] = "SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS run_id, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity / 50 END AS vaf, l_quantity AS q, l_partkey AS k FROM lineitem"


@query("q_op_somatic_vaf", "SELECT run_id, 'median_vaf' AS \"check\", CASE WHEN median(vaf) IS NULL THEN 'unverified' WHEN median(vaf) < 0.05 OR median(vaf) > 0.95 THEN 'warn' ELSE 'pass' END AS status, median(vaf) AS value, count(*) AS n_records FROM vafs GROUP BY 1")
def _(v, spark):
    from ..functions import scalars as S

    keys = F.lit("GT:AD:AF:DP")
    text = F.concat(F.lit("0/1:3,"), F.col("q").cast("int"), F.lit(":"), F.when(F.col("vaf").isNull() | (F.col("k") % 2 == 0), "x").otherwise((F.col("q") / 50).cast("string")), F.lit(":"), F.when(F.col("vaf").isNull(), "0").otherwise("50"))
    return variants.median_vaf(v("vafs").select("run_id", S.vaf_mutect(keys, text).alias("vaf")))


@query("q_op_normal_swap", "SELECT run_id, 'normal_median_vaf' AS \"check\", CASE WHEN median(vaf) > 0.3 THEN 'warn' ELSE 'pass' END AS status, median(vaf) AS value, count(*) AS n_records FROM vafs GROUP BY 1")
def _(v, spark):
    return variants.median_vaf(v("vafs"), check="normal_median_vaf", low=None, high=0.30)


@query("q_op_strelka_vaf", "SELECT run_id, 'strelka_median_vaf' AS \"check\", CASE WHEN median(q / (q + 10)) > 0.95 THEN 'warn' ELSE 'pass' END AS status, median(q / (q + 10)) AS value, count(*) AS n_records FROM vafs GROUP BY 1")
def _(v, spark):
    from ..functions import scalars as S

    snv, indel = v("vafs").where("k % 3 <> 0"), v("vafs").where("k % 3 = 0")
    a = snv.select("run_id", S.vaf_strelka_snv(F.lit("DP:AU:CU:GU:TU"), F.concat(F.lit("9:10,11:0,0:"), F.col("q").cast("int"), F.lit(",7:0,0")), F.lit("A"), F.lit("G")).alias("vaf"))
    b = indel.select("run_id", S.vaf_strelka_indel(F.lit("DP:TAR:TIR"), F.concat(F.lit("9:10,12:"), F.col("q").cast("int"), F.lit(",3"))).alias("vaf"))
    return variants.median_vaf(a.unionByName(b), check="strelka_median_vaf")


def traces(t: DataFrame) -> str:
    """Task rows as trace files."""
    sec = F.round(F.col("realtime_sec") * 1000).cast("long")
    spent = F.concat((sec / 60000).cast("long"), F.lit("m "), ((sec % 60000) / 1000).cast("long"), F.lit("s "), sec % 1000, F.lit("ms"))
    at = spread(t, ["task_id", "name", "status", "exit", "realtime", "%cpu", "peak_rss"], [F.col("task_id"), F.col("process"), F.col("status"), F.col("exit_code"), spent, F.concat("pct_cpu", F.lit("%")), F.concat(F.col("peak_rss_mb") / 1024, F.lit(" GB"))], "task_id")
    return at


@query("q_src_trace", "SELECT run_id, count(*) AS n, count(exit_code) AS with_exit, round(sum(realtime_sec), 2) AS sec, sum(peak_rss_mb) AS mb, sum(pct_cpu) AS cpu FROM tasks GROUP BY 1")
def _(v, spark):
    r = readers.trace(spark, traces(v("tasks")))
    return r.groupBy("run_id").agg(F.count("*").alias("n"), F.count("exit_code").alias("with_exit"), F.round(F.sum("realtime_sec"), 2).alias("sec"), F.sum("peak_rss_mb").alias("mb"), F.sum("pct_cpu").alias("cpu"))


@query("q_src_count_matrix", "SELECT run_id, gene_id, count FROM counts_a")
def _(v, spark):
    half = v("transcripts").select("run_id", F.col("transcript_id").alias("gene_id"), F.col("est_counts").alias("a"))
    return readers.count_matrix(spark, spread(half, ["gene_id", "name", "s1", "s2"], [F.col("gene_id"), F.lit("n"), F.col("a"), F.lit("x")], "gene_id")).select("run_id", "gene_id", "count")


@query("q_src_kallisto", "SELECT run_id, gene_id, sum(est_counts) AS count FROM transcripts JOIN t2g USING (transcript_id) GROUP BY 1, 2")
def _(v, spark):
    from ..operators import counts

    at = spread(v("transcripts"), ["target_id", "length", "est_counts", "tpm"], [F.col("transcript_id"), F.lit(1), F.col("est_counts"), F.lit(0)], "transcript_id")
    return counts.collapse_to_gene(readers.kallisto(spark, at), v("t2g"))


@query("q_src_multiqc", "SELECT run_id, sample, metric, value FROM metrics WHERE family = 'multiqc'")
def _(v, spark):
    m = v("metrics").where("family = 'multiqc'")
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("metric", c)))
    per = m.groupBy("run_id", "sample").agg(entry(F.col("value")).alias("new"), entry(F.lit(0.0)).alias("old"))
    doc = per.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", "old"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("sample", "new"))).alias("b"))
    sections = F.when(F.substring("run_id", 2, 1).cast("int") % 2 == 0, F.to_json(F.struct(F.array("a", "b").alias("report_general_stats_data")))).otherwise(F.to_json(F.struct(F.struct("a", "b").alias("report_general_stats_data"))))
    return readers.multiqc(spark, write(doc.select("run_id", F.lit(0).alias("n"), sections.alias("value"))))


@query("q_src_samplesheet", "SELECT patient AS run_id, count(*) AS n, count(fastq_2) AS paired, count(*) FILTER (WHERE fastq_1 = '') AS empty_first FROM sheets GROUP BY 1")
def _(v, spark):
    s = v("sheets").withColumn("run_id", F.concat(F.lit("r"), F.pmod(F.col("patient").cast("long"), F.lit(20))))
    at = spread(s, ["patient", "sample", "status", "fastq_1", "fastq_2"], [F.col(c) for c in ("patient", "sample", "status", "fastq_1", "fastq_2")], "patient", ",")
    return readers.samplesheet(spark, at).groupBy(F.col("patient").alias("run_id")).agg(F.count("*").alias("n"), F.count("fastq_2").alias("paired"), F.count_if(F.col("fastq_1").isNull()).alias("empty_first"))


@query("q_src_sequences", "SELECT DISTINCT run_id, name FROM gtf_names")
def _(v, spark):
    g = v("gtf_names")
    return readers.sequence_names(spark, write(g.select("run_id", F.monotonically_increasing_id().alias("n"), F.concat("name", F.lit("\texon\t1")).alias("value")).unionByName(g.select("run_id", F.lit(-1).cast("long").alias("n"), F.lit("# no\tsequence").alias("value")))), "gtf")


@query("q_src_jsonl_tolerant", "SELECT run_id, count(*) AS n FROM tasks WHERE task_id % 7 <> 0 GROUP BY 1")
def _(v, spark):
    t = v("tasks")
    body = F.to_json(F.struct("run_id", "task_id"))
    cut = F.when(F.col("task_id") % 7 == 0, F.substring(body, 1, 15)).otherwise(body)
    at = write(t.select("run_id", F.col("task_id").alias("n"), cut.alias("value")))
    return readers.jsonl(spark, at, "task_id long, run_id string", ["task_id"]).groupBy("run_id").agg(F.count("*").alias("n"))


@query("q_src_dada2", "SELECT run_id, 'S' || l AS sample, n * 10.0 AS input_reads, n * 4.0 AS nonchim, 40.0 AS percent_retained FROM (SELECT run_id, gene_id AS l, count AS n FROM counts_a)")
def _(v, spark):
    c = v("counts_a")
    at = tsv(c, ["Sample", "DADA2_input", "DADA2_nonchim"], [F.concat(F.lit("S"), "gene_id"), F.col("count") * 10, F.col("count") * 4])
    return readers.dada2(spark, at)


@query("q_src_asv", "SELECT run_id, 'S1' AS sample, count(*) FILTER (WHERE count > 40) AS asv_count FROM counts_a GROUP BY 1")
def _(v, spark):
    c = v("counts_a")
    at = tsv(c, ["ASV_ID", "S1", "sequence"], [F.concat(F.lit("a"), "gene_id"), F.when(F.col("count") > 40, F.col("count")).otherwise(0), F.lit("ACGT")])
    return readers.asv_counts(spark, at)


VIEWS["heartbeats"] = "SELECT 'u' || CAST(user_id % 40 AS STRING) AS run_id, ts, CAST(floor(event_id / 300) AS BIGINT) AS size, user_id % 40 % 3 AS mtime, CAST(1 AS BIGINT) AS n_files FROM events"


def arrivals(df: DataFrame, n: int = 3, late_sec: int = 7200) -> list[DataFrame]:
    """Rows in n parts by when they arrive, up to ``late_sec`` after their time, so that parts overlap in time."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("ts"), F.lit(late_sec))
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    part = F.floor((at - lo) * n / (hi - lo + 1)) if lo is not None else F.lit(0)
    return [df.where(part == k) for k in range(n)]


_STALL_SQL = """WITH m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR size IS DISTINCT FROM lag(size) OVER w OR mtime IS DISTINCT FROM lag(mtime) OVER w THEN ts END AS since FROM heartbeats WINDOW w AS (PARTITION BY run_id ORDER BY ts, size, mtime)),
l AS (SELECT run_id, ts, greatest(0, date_diff('microsecond', max(since) OVER (PARTITION BY run_id ORDER BY ts, size, mtime ROWS UNBOUNDED PRECEDING), ts) / 1000000) AS idle_sec FROM m)
SELECT run_id, ts, idle_sec, idle_sec >= 36000 AS stalled FROM l"""


@query("q_st_stall", _STALL_SQL)
def _(v, spark):
    return streams.stall_batch(v("heartbeats"), 36000)


@query("q_st_stall_stream", _STALL_SQL)
def _(v, spark):
    """The heartbeats as a stream, out of order by up to two hours, stopped and started again twice; a last one far ahead moves the watermark over all."""
    beats, at = v("heartbeats"), folder(spark)
    ahead = beats.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(F.lit("ahead").alias("run_id"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).cast(beats.schema["ts"].dataType).alias("ts"), *[F.lit(0).cast("long").alias(c) for c in streams.FIELDS])
    parts = [*arrivals(beats.select("run_id", "ts", *streams.FIELDS)), ahead]
    live.replay(parts, at, lambda s: (live.stall_stream(s, 36000, "3 hours", expire_ms=10**12, slot_ms=6 * 3_600_000), "append"), lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/batch={i}"))
    found = spark.read.schema(live.STALL).parquet(f"{at}/out").where("run_id <> 'ahead'")
    return found.select("run_id", F.col("ts").cast(beats.schema["ts"].dataType).alias("ts"), "idle_sec", "stalled")


@query("q_st_progress_stream", """WITH t AS (SELECT run_id, task_id % 50 AS task_id, ts, status, exit_code FROM tasks),
r AS (SELECT run_id, task_id, arg_max(status, ts) AS status, last(exit_code ORDER BY ts) AS exit_code FROM t GROUP BY 1, 2), e AS (SELECT run_id, date_diff('microsecond', min(ts), max(ts)) / 1000000 AS elapsed_sec FROM t GROUP BY 1)
SELECT run_id, count(*) AS submitted, count(*) AS completed, 0 AS running, count(*) FILTER (WHERE status = 'FAILED' OR coalesce(exit_code <> 0, false)) AS failed, any_value(elapsed_sec) AS elapsed_sec FROM r JOIN e USING (run_id) GROUP BY 1""")
def _(v, spark):
    """Task rows as a stream: tasks run again and again, some rows arrive after later ones of their task; the query is stopped and started again twice."""
    rows, at = v("tasks").select("run_id", (F.col("task_id") % 50).alias("task_id"), "ts", "status", "exit_code"), folder(spark)
    live.replay(arrivals(rows), at, lambda s: (live.progress_stream(s, expire_ms=None), "update"), lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out/batch={i}"))
    last = spark.read.schema(live.PROGRESS).parquet(f"{at}/out").groupBy("run_id").agg(F.max_by(F.struct("submitted", "completed", "running", "failed", "elapsed_sec"), "rows_seen").alias("r"))
    return last.select("run_id", "r.*")


@query("q_st_progress", """WITH r AS (SELECT run_id, task_id % 50 AS task_id, arg_max(status, ts) AS status, arg_max(exit_code, ts) AS e0, max(ts) AS ts, last(exit_code ORDER BY ts) AS exit_code FROM tasks GROUP BY 1, 2)
SELECT run_id, count(*) AS submitted, count(*) AS completed, 0 AS running, count(*) FILTER (WHERE status = 'FAILED' OR coalesce(exit_code <> 0, false)) AS failed, date_diff('microsecond', min(ts), max(ts)) / 1000000 AS elapsed_sec FROM r GROUP BY 1""")
def _(v, spark):
    return streams.progress(v("tasks").withColumn("task_id", F.col("task_id") % 50))


@query("q_st_status_feed", "SELECT ts, run_id, CASE process WHEN 'error' THEN 'failed' ELSE 'finished' END AS kind, 'm' AS message FROM tasks WHERE process IN ('error', 'view')")
def _(v, spark):
    t = v("tasks")
    kind = F.when(F.col("process") == "error", "failed").when(F.col("process") == "view", "finished").otherwise("other")
    return streams.status_feed(t.select("ts", "run_id", kind.alias("kind"), F.lit("m").alias("message")))


@query("q_st_capture_gate", """WITH vd AS (SELECT run_id, CASE max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END) FILTER (WHERE NOT informational) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' WHEN 1 THEN 'pass' ELSE 'unverified' END AS verdict FROM checks GROUP BY 1)
SELECT DISTINCT run_id, verdict FROM runs JOIN vd USING (run_id) WHERE status = 'succeeded' AND verdict IN ('fail', 'warn')""")
def _(v, spark):
    from ..operators import corpus, qc

    return corpus.capture_gate(v("runs").select("run_id", "status").distinct(), qc.verdict(v("checks")))
