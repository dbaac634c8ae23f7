"""All checks of all runs: each operator's checks for the runs of the assays it is for, in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import PAR
from . import counts, qc, variants
from .order import exact_median

COLUMNS = ["run_id", "check", "status", "value", "informational"]
VARIANT = ["variant_calling", "somatic_variant_calling"]
#: assay, family of its own reports, pack, check of a report that was found without a metric. The last three judge samples instead of MultiQC. Fixed values.
REPORTS = [
    ("rnaseq", "rnaseq_composition", "rnaseq_composition", "rnaseq_composition_qc"), ("scrnaseq", "scrnaseq", "scrnaseq", "scrnaseq_cell_qc"),
    ("methylseq", "methylseq", "methylseq", "methylseq_qc"), ("ampliseq", "ampliseq", "ampliseq", "ampliseq_qc"), ("mag", "mag", "mag", "mag_qc"),
]
DEDICATED = [r[0] for r in REPORTS[2:]]


def _of(checks: DataFrame, runs: DataFrame, assays: list[str]) -> DataFrame:
    """Checks of the runs of some assays."""
    return checks.join(runs.where(F.col("assay").isin(assays)).select("run_id").distinct(), "run_id", "left_semi")


def run_qc(spark: SparkSession, runs: DataFrame, metrics: DataFrame, calls: DataFrame, failed_reports: DataFrame | None = None, build: str | None = None, order: list[str] | None = None) -> DataFrame:
    """run_id, check, status, value, informational over all runs.

    metrics: run_id, family, sample, metric, value. Every assay's own pack judges its runs; germline runs get
    the call-set ratios and the sex checks; RNA runs the cross-sample checks. A report that was found but could not be
    read (failed_reports: run_id, check) is one unverified row.
    """
    own = metrics.join(runs.select("run_id", "assay").distinct(), "run_id")
    judged = own.join(F.broadcast(qc.rules(spark).withColumnRenamed("pack", "assay")), ["assay", "metric"])
    parts = [qc._judged(judged, ["run_id"]).select(COLUMNS)]
    germline = _of(calls, runs, ["variant_calling"])
    wide = variants.as_metrics(variants.variant_metrics(germline, order=order), ["ts_tv", "het_hom", "variant_count"])
    pack = qc.rules(spark, "variant_calling").where("metric <> 'mean_coverage'")
    parts.append(qc.rule_eval_required(wide, wide, pack).select(COLUMNS))
    parts.append(variants.sex_checks(variants.sex_inference(germline, build, order=order)).select(COLUMNS))
    rna = _of(metrics, runs, ["rnaseq"])
    flag = F.lit(False).alias("informational")
    parts.append(qc.library_skew(rna, "library_size").select("run_id", "check", "status", "value", flag))
    few = qc.min_samples(rna)
    parts.append(few.select("run_id", F.lit("min_samples").alias("check"), "status", F.col("n_samples").cast("double").alias("value"), flag))
    out = qc.mad_outliers(rna, "library_size")
    parts.append(out.select("run_id", F.concat_ws(":", F.lit("outlier"), "sample").alias("check"), "status", "value", flag))
    if failed_reports is not None:
        parts.append(failed_reports.select("run_id", "check", F.lit("unverified").alias("status"), F.lit(None).cast("double").alias("value"), flag))
    return reduce(DataFrame.unionByName, parts)


def routes(runs: DataFrame, headers: DataFrame) -> DataFrame:
    """Which of its files a run is judged by: run_id, path, role, sample, pon, build, and unverified roles with a NULL path.

    runs: run_id, assay; headers: run_id, path, annotated, pon, build, tumor, normal. The first file by path plays a role: germline (any call set of a
    germline run), annotated (the first with annotations), tumor and normal (in a mutect2 folder), strelka (the first SNV and
    the first indel file of one pair folder). A somatic run without a mutect2 file, or with strelka files of several pairs, has a role without a file.
    """
    f = headers.where(F.endswith("path", F.lit(".vcf.gz"))).join(runs.select("run_id", "assay").distinct(), "run_id").where(F.col("assay").isin(VARIANT))
    parts = F.split(F.lower("path"), "/")
    name, pair = F.element_at(parts, -1), F.get(F.split("path", "/"), F.size(parts) - 2)
    f = f.withColumn("m", F.array_contains(parts, "mutect2")).withColumn("s", F.array_contains(parts, "strelka")).withColumn("somatic", F.col("assay") == VARIANT[1])
    file = F.struct("path", "pon", "build", "tumor", "normal")
    first = lambda c: F.min(F.when(c, file))
    strelka = F.col("somatic") & F.col("s")
    a = f.groupBy("run_id").agg(
        F.bool_or("somatic").alias("somatic"), first(~F.col("somatic")).alias("germline"), first(F.col("annotated")).alias("annotated"), first(F.col("somatic") & F.col("m")).alias("tumor"),
        first(strelka & F.contains(name, F.lit("snv"))).alias("snv"), first(strelka & F.contains(name, F.lit("indel"))).alias("indel"), F.bool_or(F.col("s")).alias("has_strelka"),
        F.collect_set(F.when(F.col("m"), pair)).alias("pairs_m"), F.collect_set(F.when(F.col("s"), pair)).alias("pairs_s"),
    )
    clear = (F.size("pairs_m") <= 1) & (F.size("pairs_s") <= 1) & ((F.size("pairs_m") == 0) | (F.size("pairs_s") == 0) | (F.col("pairs_m") == F.col("pairs_s")))
    role = lambda r, c, when, sample: F.when(when, F.struct(F.lit(r).alias("role"), sample.alias("sample"), F.col(f"{c}.path").alias("path"), F.col(f"{c}.pon").alias("pon"), F.col(f"{c}.build").alias("build")))
    there = lambda c: F.col(c).isNotNull()
    named = lambda c: F.coalesce(F.col(c), F.lit("sample"))
    somatic = F.col("somatic")
    all_ = F.array_compact(F.array(
        role("germline", "germline", there("germline"), F.lit("sample")), role("annotated", "annotated", there("annotated"), F.lit("sample")), role("tumor", "tumor", there("tumor"), named("tumor.tumor")),
        role("normal", "tumor", there("tumor"), named("tumor.normal")), role("no_tumor", "tumor", somatic & ~there("tumor"), F.lit("sample")), role("strelka", "snv", somatic & clear & there("snv"), F.lit("TUMOR")),
        role("strelka", "indel", somatic & clear & there("indel"), F.lit("TUMOR")), role("no_strelka", "tumor", somatic & F.col("has_strelka") & ~clear, F.lit("sample")),
    ))
    return a.select("run_id", F.explode(all_).alias("r")).select("run_id", "r.*")


def _par(build: Column) -> Column:
    inside = F.lit(False)
    for b, chrom, lo, hi in PAR:
        inside = inside | ((build == b) & S.chrom_is(F.col("chrom"), chrom) & F.col("pos").between(lo, hi))
    return F.coalesce(inside, F.lit(False))


def _pack(name: str, metric: str, value: Column, sample: Column) -> Column:
    """A metric to be judged by a pack; NULL values end as unverified."""
    return F.struct(F.lit(name).alias("pack"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), sample.alias("sample"))


def _plain(check: Column, status: Column, value: Column | None = None, informational: bool = False) -> Column:
    value = F.lit(None).cast("double") if value is None else value.cast("double")
    return F.struct(check.alias("check"), status.alias("status"), value.alias("value"), F.lit(informational).alias("informational"))


def call_checks(spark: SparkSession, route: DataFrame, records: DataFrame, order: list[str]) -> DataFrame:
    """All checks of call sets by one scan of their records.

    records: run_id, path, chrom, pos, ref, alt, gt, ann, idx (place of the consequence), vaf_tumor, vaf_normal, vaf_strelka and the order columns. Each record goes
    to the roles of its file. The first aggregation is by run, role and what the role needs: the site where the last line of a site
    counts, the allele fraction where a median is wanted, nothing else; its counts are packed beside. The second
    one is by run and role. Medians come from the fractions' counts.
    """
    files = route.where(F.col("path").isNotNull())
    fan = records.join(files, ["run_id", "path"])
    is_ = lambda *r: F.col("role").isin(*r)
    two = ~F.contains("alt", F.lit(","))
    fraction = F.when(is_("tumor"), F.col("vaf_tumor")).when(is_("normal"), F.col("vaf_normal")).when(is_("strelka"), F.col("vaf_strelka"))
    # one expression for each need: what a role doesn't need is NULL and costs no group
    site = [F.when(is_("germline"), F.col(c)).alias(c) for c in ("chrom", "pos", "ref", "alt")]
    noted = is_("annotated") & (F.coalesce("ann", F.lit("")) != "")
    rank = S.severity_rank(F.col("term"))
    fan = fan.withColumn("noted", noted).withColumn("term", F.when(noted, S.most_severe(S.variant_terms(F.col("ann"), F.col("idx"))))).withColumn("v", F.when(two, fraction)).withColumn("two", two)
    packed = fan.select("run_id", "role", *site, "v", "gt", "noted", "two", (F.col("term").isNotNull() & (rank > 0)).alias("real"), (F.col("term").isNotNull() & (rank == 0)).alias("inter"), F.struct(*order).alias("o"), "build")
    packed = packed.groupBy("run_id", "role", "chrom", "pos", "ref", "alt", "v").agg(
        F.max_by("gt", "o").alias("gt"), F.count("*").alias("n"), F.count_if("noted").alias("noted"), F.count_if("two").alias("two"), F.count_if("real").alias("real"), F.count_if("inter").alias("inter"), F.max("build").alias("build"),
    )
    g = S.normalize_gt(F.col("gt"))
    packed = packed.withColumn("g", g)
    het, hom = variants._het(F.col("g"))
    snv, ti = S.biallelic_snv(F.col("ref"), F.col("alt")), S.transition(F.col("ref"), F.col("alt"))
    known = F.coalesce(~F.col("build").isin(*{b for b, *_ in PAR}), F.lit(True)) | ~_par(F.col("build"))
    x = known & S.chrom_is(F.col("chrom"), "x") & snv & F.col("g").isNotNull() & (F.size(F.split("g", "/")) == 2) & ~F.contains(F.col("g"), F.lit("."))
    total = packed.groupBy("run_id", "role").agg(
        F.count_if(snv & ti).alias("ti"), F.count_if(snv & ~ti).alias("tv"), F.count_if(het).alias("het"), F.count_if(hom).alias("hom"), F.count("*").alias("sites"), F.count_if(x).alias("x_sites"), F.count_if(x & het).alias("x_het"),
        F.count_if(known & S.chrom_is(F.col("chrom"), "y")).alias("y"), *[F.sum(c).alias(c) for c in ("n", "noted", "two", "real", "inter")],
    )
    middle = exact_median(packed.where(is_("tumor", "normal", "strelka") & F.col("v").isNotNull()), "v", ["run_id", "role"], "median", weight="n").drop("n_rows")
    a = route.groupBy("run_id", "role").agg(F.min("sample").alias("sample"), F.min("pon").alias("pon")).join(total, ["run_id", "role"], "left").join(middle, ["run_id", "role"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda p, q: F.try_divide(zero(p).cast("double"), F.nullif(zero(q).cast("double"), F.lit(0.0)))
    xr = F.when(zero("x_sites") >= 20, F.col("x_het") / F.col("x_sites"))
    sex = F.when(xr.isNull(), "unverified").when((xr <= 0.10) | ((xr >= 0.20) & (zero("y") < 5)), "pass").otherwise("warn")
    share = F.try_divide(F.col("noted"), F.col("n"))
    label = lambda t: F.concat(F.lit(t + ":"), F.col("sample"))
    none = F.array().cast("array<struct<pack:string,metric:string,value:double,sample:string>>")
    judged = (
        F.when(is_("germline"), F.array(_pack("variant_calling", "ts_tv", ratio("ti", "tv"), F.col("sample")), _pack("variant_calling", "het_hom", ratio("het", "hom"), F.col("sample")), _pack("variant_calling", "variant_count", zero("sites"), F.col("sample"))))
        .when(is_("annotated"), F.array(_pack("annotation_plausibility", "real_consequence_fraction", ratio("real", "noted"), F.col("sample")), _pack("annotation_plausibility", "intergenic_fraction", ratio("inter", "noted"), F.col("sample"))))
        .when(is_("tumor"), F.array(_pack("somatic_plausibility", "median_vaf", F.col("median"), F.col("sample")), _pack("somatic_plausibility", "somatic_variant_count", zero("two"), F.col("sample"))))
        .when(is_("normal"), F.array(_pack("somatic_plausibility", "normal_median_vaf", F.col("median"), F.col("sample"))))
        .when(is_("strelka"), F.array(_pack("somatic_plausibility", "strelka_median_vaf", F.col("median"), F.col("sample")))).otherwise(none)
    )
    unknown = F.lit("unverified")
    plain = (
        F.when(is_("germline"), F.array(_plain(F.lit("sex_plausibility"), sex), _plain(F.lit("x_het_ratio"), F.when(xr.isNull(), "unverified").otherwise("pass"), xr, True)))
        .when(is_("annotated"), F.array(_plain(F.lit("annotation_present"), F.lit("pass")), _plain(F.lit("annotation_complete"), F.when(share.isNull(), unknown).when(share >= 1.0, "pass").otherwise("warn"), share)))
        .when(is_("tumor"), F.array(_plain(F.lit("pon_applied"), F.coalesce("pon", unknown)))).when(is_("no_tumor"), F.array(_plain(F.lit("somatic_vaf_plausibility"), unknown)))
        .when(is_("no_strelka"), F.array(_plain(F.lit("strelka_median_vaf"), unknown))).otherwise(F.array().cast("array<struct<check:string,status:string,value:double,informational:boolean>>"))
    )
    one = a.select("run_id", F.explode(judged).alias("j")).select("run_id", "j.*").join(F.broadcast(qc.rules(spark)), ["pack", "metric"])  # a constant of a few dozen rows
    return qc._judged(one, ["run_id"]).select(COLUMNS).unionByName(a.select("run_id", F.explode(plain).alias("p")).select("run_id", "p.*").select(COLUMNS))


def all_checks(spark: SparkSession, runs: DataFrame, metrics: DataFrame, located: DataFrame, files: DataFrame, headers: DataFrame, records: DataFrame, order: list[str], others: DataFrame | None = None) -> DataFrame:
    """run_id, check, status, value, informational: every check of a finished run, for all runs at once, each routed by the run's assay.

    metrics: run_id, family, sample, metric, value (family multiqc, or the assay's own reports); located: run_id, family, sample of reports that were found;
    files: run_id, path, size. Packs judge MultiQC's samples (but those of assays with reports of their own) and own reports;
    RNA runs with MultiQC also get the plausibility pack, where a metric that isn't reported is unverified, and the cross-sample checks; a report without
    any metric is one unverified check; alignment files must hold something; for the rest see ``call_checks``. Runs whose assay has no pack
    get none. ``others`` are checks made elsewhere, such as concordances.
    """
    kind = runs.select("run_id", "assay").distinct()
    own = metrics.join(kind, "run_id")
    pack = F.lit(None).cast("string")
    for assay, family, name, _ in REPORTS:
        pack = F.when((F.col("assay") == assay) & (F.col("family") == family), name).otherwise(pack)
    pack = F.when((F.col("family") == "multiqc") & ~F.col("assay").isin(*DEDICATED), F.col("assay")).otherwise(pack)
    rules = qc.rules(spark)
    judged = own.withColumn("pack", pack).join(F.broadcast(rules), ["pack", "metric"])
    parts = [qc._judged(judged, ["run_id", "sample"]).select(COLUMNS)]
    rna = own.where((F.col("assay") == "rnaseq") & (F.col("family") == "multiqc"))
    parts.append(qc.rule_eval_required(rna, rna, qc.rules(spark, "rnaseq_plausibility")).select(COLUMNS))
    flag = F.lit(False).alias("informational")
    parts.append(qc.library_skew(rna, "library_size").select("run_id", "check", "status", "value", flag))
    parts.append(qc.min_samples(rna).select("run_id", F.lit("min_sample_count").alias("check"), "status", F.col("n_samples").cast("double").alias("value"), flag))
    parts.append(qc.mad_outliers(rna, "library_size").select("run_id", F.concat_ws(":", F.lit("outlier"), "sample").alias("check"), "status", "value", flag))
    names = F.lit(None).cast("string")
    for assay, family, _, check in REPORTS:
        names = F.when((F.col("assay") == assay) & (F.col("family") == family), check).otherwise(names)
    silent = located.select("run_id", "family", "sample").distinct().join(metrics.where(F.col("value").isNotNull()).select("run_id", "family", "sample").distinct(), ["run_id", "family", "sample"], "left_anti").join(kind, "run_id").withColumn("name", names)
    parts.append(silent.where(F.col("name").isNotNull()).select("run_id", F.concat_ws(":", "name", "sample").alias("check"), F.lit("unverified").alias("status"), F.lit(None).cast("double").alias("value"), flag))
    bam = files.where(F.endswith("path", F.lit(".bam"))).join(kind, "run_id", "left_semi")
    parts.append(bam.select("run_id", F.concat(F.lit("output_present:"), F.element_at(F.split("path", "/"), -1)).alias("check"), F.when(F.col("size") > 0, "pass").otherwise("fail").alias("status"), F.col("size").cast("double").alias("value"), flag))
    parts.append(call_checks(spark, routes(runs, headers), records, order))
    return reduce(DataFrame.unionByName, parts + ([others.select(COLUMNS)] if others is not None else []))


def sc_count_concordance(a: DataFrame, b: DataFrame, errors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count concordance of two single-cell matrices' gene totals; runs with a parse error are unverified rows."""
    keys = keys or ["run_id"]
    good = counts.count_concordance(a.join(errors, keys, "left_anti"), b.join(errors, keys, "left_anti"), keys)
    bad = errors.select(*keys).distinct()
    for f in good.schema:
        if f.name not in keys:
            value = F.lit("unverified") if f.name.endswith("status") else F.lit(None).cast(f.dataType)
            bad = bad.withColumn(f.name, value)
    return good.unionByName(bad)
