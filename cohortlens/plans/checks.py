"""The assembled checks of finished runs of all assays, with their DuckDB twin: every check's status and value is compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import assembly
from . import files  # noqa: F401  has views that are used here
from .core import _DIFF, _PAR37, _SNV, _TI, _TWO, BAND, GT_SQL, ORDER, query
from .views import VIEWS

_K = "l_suppkey % 10"
VIEWS["qc_kinds"] = f"SELECT DISTINCT 'r' || CAST({_K} AS STRING) AS run_id, CASE {_K} WHEN 1 THEN 'variant_calling' WHEN 7 THEN 'variant_calling' WHEN 2 THEN 'somatic_variant_calling' WHEN 8 THEN 'somatic_variant_calling' WHEN 3 THEN 'scrnaseq' WHEN 4 THEN 'methylseq' WHEN 5 THEN 'ampliseq' WHEN 6 THEN 'mag' ELSE 'rnaseq' END AS assay FROM lineitem"
VIEWS["qc_records"] = f"""
SELECT 'r' || CAST({_K} AS STRING) AS run_id,
       CASE WHEN {_K} = 2 THEN CASE WHEN l_linenumber <= 3 THEN 'out/mutect2/t_n/x.vcf.gz' WHEN l_linenumber <= 5 THEN 'out/strelka/t_n/x.somatic_snvs.vcf.gz' ELSE 'out/strelka/t_n/x.somatic_indels.vcf.gz' END
            WHEN {_K} = 8 THEN CASE WHEN l_linenumber <= 3 THEN 'out/other/x.vcf.gz' WHEN l_linenumber <= 5 THEN 'out/strelka/p1/x.somatic_snvs.vcf.gz' ELSE 'out/strelka/p2/x.somatic_indels.vcf.gz' END
            WHEN l_linenumber <= 4 THEN 'out/a.vcf.gz' ELSE 'out/b.vcf.gz' END AS path,
       CASE WHEN l_partkey % 25 < 22 THEN CAST(l_partkey % 25 + 1 AS STRING) WHEN l_partkey % 25 = 22 THEN 'chrX' WHEN l_partkey % 25 = 23 THEN 'Y' ELSE 'M' END AS chrom, l_orderkey * 400 AS pos,
       substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS ref, substr('ACGT', CAST((l_partkey + CASE WHEN l_orderkey % 10 < 5 + l_suppkey % 5 THEN 2 ELSE 1 END) % 4 AS INT) + 1, 1) || CASE WHEN l_partkey % 17 = 0 THEN ',T' ELSE '' END AS alt,
       CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' WHEN 2 THEN '1/1' WHEN 3 THEN './.' ELSE '1/2' END AS gt,
       CASE l_orderkey % 5 WHEN 0 THEN 'A|intergenic_variant|' WHEN 1 THEN 'A|Missense_variant&splice_region_variant|TP53,A|intron_variant|X' WHEN 2 THEN '' ELSE 'A|stop_gained|KRAS' END AS ann,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity / 50 END AS vaf_tumor, l_quantity / 60 AS vaf_normal, l_quantity / (l_quantity + 10) AS vaf_strelka, l_linenumber AS o1, l_extendedprice AS o2, l_quantity AS o3
FROM lineitem"""
VIEWS["qc_headers"] = "SELECT run_id, path, path LIKE '%b.vcf.gz' OR path LIKE '%mutect2%' AS annotated, 'warn' AS pon, 'GRCh37' AS build, 'T' AS tumor, CAST(NULL AS STRING) AS normal FROM qc_records GROUP BY run_id, path"
VIEWS["qc_metrics"] = f"""
SELECT 'r' || CAST({_K} AS STRING) AS run_id, CASE metric WHEN 'exonic_fraction' THEN 'rnaseq_composition' WHEN 'estimated_cells' THEN 'scrnaseq' WHEN 'percent_aligned' THEN 'methylseq' WHEN 'asv_count' THEN 'ampliseq' WHEN 'completeness' THEN 'mag' ELSE 'multiqc' END AS family,
       'S' || CAST(l_suppkey AS STRING) || CASE WHEN l_linenumber = 1 THEN ' Read 1' ELSE '' END AS sample, metric,
       CASE metric WHEN 'uniquely_mapped_percent' THEN avg(l_quantity) * 2.4 WHEN 'percent_rRNA' THEN avg(l_quantity) / 3 WHEN 'exonic_fraction' THEN avg(l_quantity) / 50 WHEN 'percent_aligned' THEN avg(l_quantity) * 1.2 WHEN 'asv_count' THEN avg(l_quantity) * 2 WHEN 'completeness' THEN avg(l_quantity) * 2.5 ELSE sum(l_quantity) END AS value
FROM lineitem CROSS JOIN (SELECT 'uniquely_mapped_percent' AS metric UNION ALL SELECT 'percent_rRNA' UNION ALL SELECT 'library_size' UNION ALL SELECT 'exonic_fraction' UNION ALL SELECT 'estimated_cells' UNION ALL SELECT 'percent_aligned' UNION ALL SELECT 'asv_count' UNION ALL SELECT 'completeness') k
WHERE NOT (metric = 'percent_rRNA' AND l_suppkey % 3 = 0) GROUP BY l_suppkey, l_linenumber = 1, metric, CASE WHEN l_linenumber = 1 THEN ' Read 1' ELSE '' END"""
VIEWS["qc_located"] = f"SELECT DISTINCT 'r' || CAST({_K} AS STRING) AS run_id, CASE {_K} WHEN 3 THEN 'scrnaseq' WHEN 4 THEN 'methylseq' WHEN 5 THEN 'ampliseq' WHEN 6 THEN 'mag' ELSE 'rnaseq_composition' END AS family, CASE WHEN l_suppkey % 4 = 0 THEN 'ghost' || CAST(l_suppkey AS STRING) ELSE 'S' || CAST(l_suppkey AS STRING) END AS sample FROM lineitem WHERE l_linenumber > 1"

_lit = lambda v, kind: f"CAST({'NULL' if v is None else repr(v)} AS {kind})"
_PACKS = ", ".join("(" + ", ".join(_lit(v, "VARCHAR" if i in (0, 1, 2, 7) else "DOUBLE") for i, v in enumerate(r)) + ")" for r in T.RULES)
_OWN = " ".join(f"WHEN assay = '{a}' AND family = '{f}' THEN '{p}'" for a, f, p, _ in assembly.REPORTS)
_SILENT = " ".join(f"WHEN assay = '{a}' AND family = '{f}' THEN '{c}'" for a, f, _, c in assembly.REPORTS)
_DEDICATED = ", ".join(f"'{a}'" for a in assembly.DEDICATED)
_TERM = "lower(split_part(split_part(ann, ',', 1), '|', 2))"
_SOMATIC = "assay = 'somatic_variant_calling'"

CHECKS_SQL = f"""
WITH packs AS (SELECT * FROM (VALUES {_PACKS}) p(pack, "check", metric, fail_below, warn_below, warn_above, fail_above, unit)),
own AS (SELECT m.*, assay FROM qc_metrics m JOIN qc_kinds USING (run_id)),
h AS (SELECT qc_headers.*, assay FROM qc_headers JOIN qc_kinds USING (run_id) WHERE assay IN ('variant_calling', 'somatic_variant_calling')),
germ AS (SELECT run_id, min(path) AS path FROM h WHERE assay = 'variant_calling' GROUP BY 1),
noted AS (SELECT run_id, min(path) AS path FROM h WHERE annotated GROUP BY 1),
mut AS (SELECT run_id, min(path) AS path FROM h WHERE {_SOMATIC} AND path LIKE '%/mutect2/%' GROUP BY 1),
str AS (SELECT run_id, min(path) FILTER (WHERE path LIKE '%snv%') AS snv, min(path) FILTER (WHERE path LIKE '%indel%') AS indel, count(DISTINCT split_part(path, '/', 3)) AS pairs FROM h WHERE {_SOMATIC} AND path LIKE '%/strelka/%' GROUP BY 1),
s AS (SELECT run_id, chrom, pos, ref, alt, last({GT_SQL} ORDER BY o1, o2, o3) AS g FROM qc_records JOIN germ USING (run_id, path) GROUP BY ALL),
w AS (SELECT run_id, count(*) FILTER (WHERE {_SNV} AND {_TI}) / nullif(count(*) FILTER (WHERE {_SNV} AND NOT {_TI}), 0) AS ts_tv,
      count(*) FILTER (WHERE {_TWO} AND {_DIFF}) / nullif(count(*) FILTER (WHERE {_TWO} AND NOT {_DIFF} AND split_part(g, '/', 1) <> '0'), 0) AS het_hom, CAST(count(*) AS DOUBLE) AS variant_count FROM s GROUP BY 1),
x AS (SELECT run_id, count(*) FILTER (WHERE chrom = 'chrX' AND {_SNV} AND g IS NOT NULL AND {_TWO} AND NOT contains(g, '.')) AS n,
      count(*) FILTER (WHERE chrom = 'chrX' AND {_SNV} AND g IS NOT NULL AND {_TWO} AND NOT contains(g, '.') AND {_DIFF}) AS h, count(*) FILTER (WHERE chrom = 'Y') AS y FROM s WHERE NOT ({_PAR37}) GROUP BY 1),
sex AS (SELECT germ.run_id, CASE WHEN n >= 20 THEN h / n END AS r, coalesce(y, 0) AS y FROM germ LEFT JOIN x USING (run_id)),
a AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE ann <> '') AS noted, count(*) FILTER (WHERE ann <> '' AND {_TERM} <> 'intergenic_variant') AS "real", count(*) FILTER (WHERE {_TERM} = 'intergenic_variant') AS inter FROM qc_records JOIN noted USING (run_id, path) GROUP BY 1),
t AS (SELECT run_id, median(vaf_tumor) FILTER (WHERE NOT contains(alt, ',')) AS tumor, median(vaf_normal) FILTER (WHERE NOT contains(alt, ',')) AS normal, count(*) FILTER (WHERE NOT contains(alt, ',')) AS n FROM qc_records JOIN mut USING (run_id, path) GROUP BY 1),
sv AS (SELECT r.run_id, median(vaf_strelka) AS v FROM qc_records r JOIN str ON r.run_id = str.run_id AND r.path IN (str.snv, str.indel) WHERE pairs = 1 AND NOT contains(alt, ',') GROUP BY 1),
found AS (
  SELECT run_id, sample, metric, value, CASE {_OWN} WHEN family = 'multiqc' AND assay NOT IN ({_DEDICATED}) THEN assay END AS pack FROM own
  UNION ALL SELECT run_id, 'sample', m, v, 'variant_calling' FROM (SELECT run_id, unnest(['ts_tv', 'het_hom', 'variant_count']) AS m, unnest([ts_tv, het_hom, variant_count]) AS v FROM w)
  UNION ALL SELECT run_id, 'sample', m, v, 'annotation_plausibility' FROM (SELECT run_id, unnest(['real_consequence_fraction', 'intergenic_fraction']) AS m, unnest(["real" / noted, inter / noted]) AS v FROM a)
  UNION ALL SELECT run_id, 'T', m, v, 'somatic_plausibility' FROM (SELECT run_id, unnest(['median_vaf', 'somatic_variant_count']) AS m, unnest([tumor, n]) AS v FROM t)
  UNION ALL SELECT run_id, 'sample', 'normal_median_vaf', normal, 'somatic_plausibility' FROM t
  UNION ALL SELECT run_id, 'TUMOR', 'strelka_median_vaf', v, 'somatic_plausibility' FROM sv
  UNION ALL SELECT d.run_id, d.sample, p.metric, o.value, 'rnaseq_plausibility' FROM (SELECT DISTINCT run_id, sample FROM own WHERE assay = 'rnaseq' AND family = 'multiqc') d CROSS JOIN (SELECT metric FROM packs WHERE pack = 'rnaseq_plausibility') p LEFT JOIN own o ON o.run_id = d.run_id AND o.sample = d.sample AND o.metric = p.metric AND o.family = 'multiqc'
),
lib AS (SELECT run_id, sample, value FROM own WHERE assay = 'rnaseq' AND family = 'multiqc' AND metric = 'library_size'), q AS (SELECT run_id, median(value) AS med FROM lib GROUP BY 1 HAVING count(*) >= 3), d AS (SELECT lib.*, abs(value - med) AS dev FROM lib JOIN q USING (run_id)), mad AS (SELECT run_id, median(dev) AS mad FROM d GROUP BY 1 HAVING median(dev) > 0),
skew AS (SELECT run_id, max(value) AS hi, min(value) AS lo FROM lib GROUP BY 1 HAVING count(*) >= 2),
few AS (SELECT run_id, count(DISTINCT regexp_replace(sample, ' Read [0-9]+$', '')) AS n FROM own WHERE assay = 'rnaseq' AND family = 'multiqc' GROUP BY 1),
named AS (SELECT run_id, family, sample, CASE {_SILENT} END AS name FROM qc_located JOIN qc_kinds USING (run_id) WHERE NOT EXISTS (SELECT 1 FROM qc_metrics m WHERE m.run_id = qc_located.run_id AND m.family = qc_located.family AND m.sample = qc_located.sample)),
made AS (
  SELECT run_id, p."check" || ':' || sample AS "check", {BAND} AS status, value, coalesce(fail_below, warn_below, warn_above, fail_above) IS NULL AS informational FROM found f JOIN packs p ON p.pack = f.pack AND p.metric = f.metric
  UNION ALL SELECT run_id, 'sex_plausibility', CASE WHEN r IS NULL THEN 'unverified' WHEN r <= 0.1 OR (r >= 0.2 AND y < 5) THEN 'pass' ELSE 'warn' END, NULL, false FROM sex
  UNION ALL SELECT run_id, 'x_het_ratio', CASE WHEN r IS NULL THEN 'unverified' ELSE 'pass' END, r, true FROM sex
  UNION ALL SELECT run_id, 'annotation_present', 'pass', NULL, false FROM a
  UNION ALL SELECT run_id, 'annotation_complete', CASE WHEN noted = n THEN 'pass' ELSE 'warn' END, noted / n, false FROM a
  UNION ALL SELECT run_id, 'pon_applied', 'warn', NULL, false FROM mut
  UNION ALL SELECT DISTINCT run_id, 'somatic_vaf_plausibility', 'unverified', CAST(NULL AS DOUBLE), false FROM h WHERE {_SOMATIC} AND run_id NOT IN (SELECT run_id FROM mut)
  UNION ALL SELECT run_id, 'strelka_median_vaf', 'unverified', NULL, false FROM str WHERE pairs > 1
  UNION ALL SELECT run_id, 'library_size_skew', CASE WHEN hi = 0 THEN 'unverified' WHEN lo = 0 OR hi / lo >= 10 THEN 'fail' WHEN hi / lo >= 3 THEN 'warn' ELSE 'pass' END, CASE WHEN lo > 0 THEN hi / lo END, false FROM skew
  UNION ALL SELECT run_id, 'min_sample_count', CASE WHEN n < 2 THEN 'fail' ELSE 'pass' END, CAST(n AS DOUBLE), false FROM few
  UNION ALL SELECT run_id, 'outlier:' || sample, 'warn', value, false FROM d JOIN mad USING (run_id) WHERE dev / mad > 3
  UNION ALL SELECT run_id, name || ':' || sample, 'unverified', NULL, false FROM named WHERE name IS NOT NULL
  UNION ALL SELECT run_id, 'output_present:' || split_part(path, '/', 3), CASE WHEN size > 0 THEN 'pass' ELSE 'fail' END, CAST(size AS DOUBLE), false FROM artifacts WHERE path LIKE '%.bam' AND run_id IN (SELECT run_id FROM qc_kinds)
)
SELECT run_id, "check", status, value, informational FROM made"""


@query("q_op_run_qc_checks", CHECKS_SQL)
def _(v, spark):
    """Runs of seven assays; a somatic run whose callers lie in one pair folder and one without a mutect2 file; reports with and without metrics."""
    headers = v("qc_records").groupBy("run_id", "path").agg(F.lit("warn").alias("pon"), F.lit("GRCh37").alias("build"), F.lit("T").alias("tumor"), F.lit(None).cast("string").alias("normal"))
    headers = headers.withColumn("annotated", F.endswith("path", F.lit("b.vcf.gz")) | F.contains("path", F.lit("mutect2")))
    records = v("qc_records").withColumn("idx", F.lit(1))
    return assembly.all_checks(spark, v("qc_kinds"), v("qc_metrics"), v("qc_located"), v("artifacts"), headers, records, ORDER)
