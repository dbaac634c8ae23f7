"""Views of the given tables in the shapes the operators take; one text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "conversations"]

_CALLS = """
SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS run_id,
       CASE WHEN l_partkey % 25 < 22 THEN CAST(l_partkey % 25 + 1 AS STRING) WHEN l_partkey % 25 = 22 THEN 'chrX' WHEN l_partkey % 25 = 23 THEN 'Y' ELSE 'M' END AS chrom,
       l_orderkey * 400 AS pos,
       substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS ref,
       substr('ACGT', CAST((l_partkey + CASE WHEN l_orderkey % 10 < 5 + l_suppkey % 5 THEN 2 ELSE 1 END) % 4 AS INT) + 1, 1) AS alt,
       {gt} AS gt,
       CASE l_returnflag WHEN 'R' THEN 'LowQual' WHEN 'A' THEN 'PASS' ELSE '.' END AS filter,
       l_linenumber AS o1, l_extendedprice AS o2, l_quantity AS o3
FROM lineitem {where}"""
_GT = "CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' WHEN 2 THEN '1/1' WHEN 3 THEN '0/0' WHEN 4 THEN './.' WHEN 5 THEN '1|1' ELSE '1/2' END"

VIEWS: dict[str, str] = {
    "calls_a": _CALLS.format(gt=_GT, where=""),
    "calls_b": _CALLS.format(gt=f"CASE WHEN l_partkey % 13 = 0 THEN '1/1' ELSE {_GT} END", where="WHERE l_linenumber % 5 <> 0"),
    "counts_a": "SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS run_id, CAST(l_partkey AS STRING) AS gene_id, SUM(l_quantity) AS count FROM lineitem GROUP BY 1, 2",
    "counts_b": "SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS run_id, CAST(l_partkey AS STRING) AS gene_id, SUM(CASE WHEN l_linestatus = 'F' THEN 2 * l_quantity ELSE l_quantity END) AS count FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2",
    "transcripts": "SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS run_id, CAST(l_partkey AS STRING) AS transcript_id, l_quantity AS est_counts FROM lineitem",
    "t2g": "SELECT CAST(p_partkey AS STRING) AS transcript_id, p_brand AS gene_id FROM part WHERE p_size > 5",
    "metrics": """
SELECT run_id, family, sample, metric, CASE metric WHEN 'uniquely_mapped_percent' THEN q * 2.4 WHEN 'percent_assigned' THEN q * 2.0 + 2 WHEN 'percent_mapped' THEN q * 1.7 ELSE s END AS value
FROM (SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS run_id, 'S' || CAST(l_suppkey AS STRING) || CASE WHEN l_linenumber = 1 THEN ' Read 1' ELSE '' END AS sample, AVG(l_quantity) AS q, SUM(l_quantity) AS s
      FROM lineitem WHERE l_linenumber <> 7 OR l_suppkey % 3 = 0 GROUP BY 1, 2) m
CROSS JOIN (SELECT 'multiqc' AS family, 'uniquely_mapped_percent' AS metric UNION ALL SELECT 'multiqc', 'percent_assigned' UNION ALL SELECT 'salmon', 'percent_mapped' UNION ALL SELECT 'library', 'library_size') k
WHERE NOT (metric = 'percent_mapped' AND sample LIKE '%Read%')""",
    "tasks": """
SELECT 'u' || CAST(user_id % 40 AS STRING) AS run_id, event_id AS task_id, event_type AS process, ts,
       CASE WHEN event_type = 'error' AND user_id % 40 > 9 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' AND user_id % 40 > 9 AND value > 50 THEN 137 WHEN event_type = 'error' AND user_id % 40 > 9 THEN 1 ELSE 0 END AS exit_code,
       value AS realtime_sec, CAST(event_id % 64 AS DOUBLE) * 64 AS peak_rss_mb, CAST(event_id % 8 AS DOUBLE) * 50 AS pct_cpu
FROM events""",
    "runs": """
SELECT 'u' || CAST(user_id % 40 AS STRING) AS run_id, CASE WHEN user_id % 4 = 0 THEN 'rnaseq' WHEN user_id % 4 = 1 THEN 'variant_calling' WHEN user_id % 4 = 2 THEN 'mag' ELSE 'methylseq' END AS assay,
       MIN(ts) AS started, MAX(ts) AS ended, CASE WHEN user_id % 40 % 7 = 3 THEN 'failed' ELSE 'succeeded' END AS status
FROM events GROUP BY 1, 2, 5""",
    "checks": """
SELECT 'u' || CAST(user_id % 40 AS STRING) AS run_id, 'S' || CAST(event_id % 6 AS STRING) AS sample, event_type || ':' || CAST(event_id AS STRING) AS "check",
       CASE WHEN value > 220 AND user_id % 40 < 20 THEN 'fail' WHEN value > 150 THEN 'warn' WHEN event_id % 97 = 0 THEN 'unverified' ELSE 'pass' END AS status, value, event_id % 11 = 0 AS informational
FROM events WHERE user_id % 40 <> 5""",
    "sizes": "SELECT 'u' || CAST(user_id % 40 AS STRING) AS run_id, MAX(CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) END) AS target_gb, MAX(CASE WHEN event_type = 'view' AND user_id % 3 = 0 THEN CAST(floor(value / 4) AS BIGINT) END) AS target_h FROM events GROUP BY 1",
    "history": "SELECT p_brand AS pipeline, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END AS status, l_extendedprice AS runtime_sec, CAST(l_quantity AS BIGINT) AS n_samples, l_extendedprice / 8 AS peak_mb FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10",
    "requests": "SELECT p_partkey AS request_id, p_brand || CASE WHEN p_size > 45 THEN 'x' ELSE '' END AS pipeline, CAST(p_size AS BIGINT) AS n_samples FROM part",
    "steps": "SELECT 'o' || CAST(o_custkey AS STRING) AS run_id, CASE WHEN o_custkey % 5 = 0 THEN 'oom' WHEN o_custkey % 5 = 1 THEN 'time_limit' ELSE 'tool_crash' END AS failure_class, o_totalprice > 200000 AS patch_applied, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'failed' END AS outcome FROM orders",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables that its text names; Catalyst sees plain scans and prunes them."""
    text = re.sub(r"sha256\((\w+)\)", r"sha2(\1, 256)", re.sub(r'"(check|key)"', r"`\1`", VIEWS[name]).replace("chr(10)", "char(10)"))
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def duck(sql: str) -> str:
    """A query with the views it names put before it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"

_NEEDLES = [
    "Terminating the stalled run", "java.lang.OutOfMemoryError: heap", "CANCELLED DUE TO TIME LIMIT", "No space left on device", "open: Permission denied", "Cannot connect to the Docker daemon",
    "Failed to pull image", "Connection timed out", "ResolvePackageNotFound: x", "index file ref.fai is older than ref.fasta", "sample.bai not found", "ref.dict does not exist", "Could not open genome file",
    "No such file or directory: genome.gtf", "unknown option --foo", "Cannot index files compressed with gzip", "Failed cram_decode_slice in a.cram", "requested image's platform (arm64)", "nothing to report",
]
_q = lambda s: "'" + s.replace("'", "''") + "'"
_GOALS = ["single-cell atlas", "RNA-seq differential expression", "somatic calls of a tumour", "germline variant calling", "bisulfite methylation", "shotgun metagenomics", "16S amplicon survey", "call SNPs"]
_MARK = "@N"
_SENTENCES = ["The AUC was 0.91 in test.", "accuracy of @N% reached", "F1 score: 0.@N here", "recall < 0.5 was seen", "Pearson correlation = 0.8@N overall", "nothing measured"]

VIEWS |= {
    "logs": f"SELECT 'd' || CAST(doc_id AS STRING) AS run_id, coalesce(text, '') || chr(10) || CASE doc_id % 19 {' '.join(f'WHEN {i} THEN {_q(n)}' for i, n in enumerate(_NEEDLES))} END || chr(10) || 'task ' || CAST(doc_id % 7 AS STRING) || ' at /tmp/run/' || CAST(doc_id AS STRING) AS log_text FROM documents",
    "log_events": "SELECT 'd' || CAST(doc_id AS STRING) AS run_id, CASE WHEN doc_id % 3 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN doc_id % 23 = 0 THEN 137 WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS exit_code FROM documents",
    "goals": f"SELECT CAST(conv_id * 1000 + turn AS STRING) AS goal_id, CAST(conv_id AS STRING) AS sheet_id, coalesce(text, '') || ' ' || CASE conv_id % 9 {' '.join(f'WHEN {i} THEN {_q(g)}' for i, g in enumerate(_GOALS))} ELSE 'hello' END AS goal FROM conversations",
    "sheets": "SELECT CAST(o_custkey AS STRING) AS sheet_id, 'S' || CAST(o_orderkey % 3 AS STRING) AS sample, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'f' || CAST(o_orderkey % 1000 AS STRING) || '.fq' END AS fastq_1, CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'x.fq' ELSE NULL END AS fastq_2, CASE WHEN o_orderkey % 50 = 0 THEN '2' WHEN o_totalprice > 300000 THEN '0' ELSE '1' END AS status, CAST(o_custkey AS STRING) AS patient FROM orders",
    "claim_texts": f"SELECT doc_id, coalesce(text, '') || ' ' || CASE doc_id % 6 {' '.join(f'WHEN {i} THEN replace({_q(s)}, {_q(_MARK)}, CAST(doc_id % 5 + 1 AS STRING))' for i, s in enumerate(_SENTENCES))} END || ' End.' AS text FROM documents",
    "cases": "SELECT CAST(l.doc_id AS STRING) AS case_id, CASE WHEN quality = 0 THEN 'junk' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS expected, CASE WHEN length(text) < 300 THEN 'junk' WHEN l.doc_id % 11 = 0 THEN 'toxic' ELSE 'clean' END AS predicted, CASE WHEN l.doc_id % 2 = 0 THEN 'pending:auto' ELSE 'user:report' END AS source FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "family_status": "SELECT CAST(user_id AS STRING) AS case_id, event_type AS family, CASE WHEN max(value) > 300 THEN 'fail' WHEN max(value) > 150 THEN 'warn' ELSE 'pass' END AS status FROM events GROUP BY user_id, event_type",
    "case_labels": "SELECT DISTINCT CAST(user_id AS STRING) AS case_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'fail' ELSE 'warn' END AS label FROM events",
    "snapshots": "SELECT o_orderpriority AS metric, o_orderdate AS ts, avg(o_totalprice) / 500000 AS value, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS detector FROM orders GROUP BY 1, 2, 4",
    "rates": "SELECT o_orderpriority AS guard, avg(CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE)) AS value, CAST(count(*) % 2 AS STRING) AS corpus_sha FROM orders GROUP BY 1",
    "baselines": "SELECT o_orderpriority AS guard, avg(CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE)) AS value, '0' AS corpus_sha FROM orders WHERE o_orderdate < CAST('1997-01-01' AS TIMESTAMP) AND o_orderpriority <> '5-LOW' GROUP BY 1",
    "paper_claims": "SELECT p_brand AS run_id, 'c' || CAST(p_partkey AS STRING) AS claim_id, p_type AS family, p_retailprice AS claimed, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice * (1 + CAST(p_size % 5 AS DOUBLE) / 20) END AS observed, CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE 0.01 END AS tolerance, CASE WHEN p_size % 5 = 0 THEN 'reproduced' ELSE 'diverged' END AS expected, p_size AS exit_code, p_size % 3 AS repairs FROM part",
    "items": "SELECT 'y' || CAST(CASE WHEN o_orderdate < CAST('1997-01-01' AS TIMESTAMP) THEN 0 ELSE 1 END AS STRING) AS run_id, o_orderpriority AS section, CAST(o_custkey AS STRING) AS \"key\", CAST(count(*) AS STRING) AS value FROM orders GROUP BY 1, 2, 3",
    "bench": "SELECT 'r' || CAST(l_suppkey % 10 AS STRING) AS run_id, 'p' || CAST(l_suppkey % 3 AS STRING) AS pipeline, 'm' || CAST(l_linenumber AS STRING) AS \"check\", avg(l_quantity) AS value FROM lineitem WHERE l_suppkey % 10 <> 4 OR l_linenumber < 6 GROUP BY 1, 2, 3",
    "bench_reference": "SELECT 'p' || CAST(l_suppkey % 3 AS STRING) AS pipeline, 'm' || CAST(l_linenumber AS STRING) AS \"check\", avg(l_quantity) AS value FROM lineitem WHERE l_suppkey % 3 <> 2 GROUP BY 1, 2",
    "artifacts": "SELECT 'r' || CAST(page_id % 20 AS STRING) AS run_id, 'out/' || CAST(page_id % 3 AS STRING) || '/f' || CAST(page_id % 90 AS STRING) || CASE page_id % 5 WHEN 0 THEN '.bam' WHEN 1 THEN '.vcf.gz' WHEN 2 THEN '.fasta' WHEN 3 THEN '.bam.bai' ELSE '.txt' END AS path, CASE WHEN page_id % 31 = 0 THEN 0 ELSE length(html) END AS size, sha256(html) AS sha256, page_id FROM pages",
    "artifacts_now": "SELECT 'r' || CAST(page_id % 20 AS STRING) AS run_id, 'out/' || CAST(page_id % 3 AS STRING) || '/f' || CAST(page_id % 90 AS STRING) || CASE page_id % 5 WHEN 0 THEN '.bam' WHEN 1 THEN '.vcf.gz' WHEN 2 THEN '.fasta' WHEN 3 THEN '.bam.bai' ELSE '.txt' END AS path, sha256(content) AS sha256 FROM (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN url ELSE html END AS content FROM pages WHERE page_id % 17 <> 0) p",
    "fasta_names": "SELECT 'r' || CAST(c_nationkey AS STRING) AS run_id, CASE WHEN c_nationkey % 2 = 0 THEN 'chr' || CAST(c_custkey % 30 AS STRING) ELSE CAST(c_custkey % 30 AS STRING) END AS name FROM customer",
    "gtf_names": "SELECT 'r' || CAST(c_nationkey AS STRING) AS run_id, CASE WHEN c_nationkey % 3 = 0 THEN CAST(c_custkey % 25 AS STRING) WHEN c_custkey % 30 = 7 THEN 'MT' ELSE 'chr' || CAST(c_custkey % 25 AS STRING) END AS name FROM customer WHERE c_nationkey <> 11",
}
