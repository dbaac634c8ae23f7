"""Call sets: concordance, ratios, sex and allele-fraction checks, for all runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import PAR
from .order import exact_median

SITE = ["chrom", "pos", "ref", "alt"]


def last_wins(calls: DataFrame, value: str, order: list[str], keys: list[str]) -> DataFrame:
    """One row for each key with the value of its last row in file order; aggregates before the shuffle."""
    return calls.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def genotype_concordance(a: DataFrame, b: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, gt: str = "gt") -> DataFrame:
    """Shared and united sites, comparable and concordant genotypes, rate and overlap, with statuses.

    Both sides are tagged and united, so duplicates and the full outer match take one shuffle on the site.
    """
    keys, order = keys or ["run_id"], order or ["line"]
    tag = lambda df, side: df.select(*keys, *SITE, F.struct(*order).alias("o"), S.normalize_gt(F.col(gt)).alias("g"), F.lit(side).alias("side"))
    both = tag(a, 1).unionByName(tag(b, 2))
    pick = lambda side: F.max_by(F.struct("g"), F.when(F.col("side") == side, F.col("o")))
    site = both.groupBy(*keys, *SITE).agg(F.bit_or("side").alias("sides"), pick(1)["g"].alias("ga"), pick(2)["g"].alias("gb"))
    shared = F.col("sides") == 3
    known = shared & F.col("ga").isNotNull() & F.col("gb").isNotNull()
    run = site.groupBy(*keys).agg(
        F.count_if(shared).alias("shared"), F.count("*").alias("n_union"), F.count_if(known).alias("comparable"), F.count_if(known & (F.col("ga") == F.col("gb"))).alias("concordant")
    )
    rate = F.when(F.col("comparable") > 0, F.col("concordant") / F.col("comparable"))
    overlap = F.when(F.col("n_union") > 0, F.col("shared") / F.col("n_union")).otherwise(0.0)
    status = lambda c: F.when(F.col(c).isNull(), "unverified").when(F.col(c) < 0.90, "warn").otherwise("pass")
    out = run.withColumn("rate", rate).withColumn("overlap", overlap)
    return out.withColumn("rate_status", status("rate")).withColumn("overlap_status", status("overlap"))


def somatic_overlap(a: DataFrame, b: DataFrame, keys: list[str] | None = None, least: int = 10) -> DataFrame:
    """Jaccard overlap of PASS sites; unverified under ``least`` united sites, warn under 0.90."""
    keys = keys or ["run_id"]
    passed = lambda df, side: df.where(F.trim("filter").isin("PASS", ".")).select(*keys, *SITE, F.lit(side).alias("side"))
    site = passed(a, 1).unionByName(passed(b, 2)).groupBy(*keys, *SITE).agg(F.bit_or("side").alias("sides"))
    run = site.groupBy(*keys).agg(F.count_if(F.col("sides") == 3).alias("shared"), F.count("*").alias("n_union"))
    jaccard = F.col("shared") / F.col("n_union")
    return run.withColumn("jaccard", jaccard).withColumn("status", F.when(F.col("n_union") < least, "unverified").when(F.col("jaccard") < 0.90, "warn").otherwise("pass"))


def site_union(*callers: DataFrame) -> DataFrame:
    """Distinct sites of several files of one caller."""
    out = callers[0]
    for c in callers[1:]:
        out = out.unionByName(c)
    return out.distinct()


def _het(g: Column) -> tuple[Column, Column]:
    alleles = F.split(g, "/")
    two = F.size(alleles) == 2
    a, b = F.get(alleles, F.lit(0)), F.get(alleles, F.lit(1))
    return two & (a != b), two & (a == b) & (a != "0")


def _sites(calls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return last_wins(calls, "gt", order, [*keys, *SITE]).withColumn("g", S.normalize_gt(F.col("gt")))


def variant_metrics(calls: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """ts_tv, het_hom (NULL where the denominator is 0) and variant_count of distinct sites."""
    keys = keys or ["run_id"]
    s = _sites(calls, keys, order or ["line"])
    snv, ti = S.biallelic_snv(F.col("ref"), F.col("alt")), S.transition(F.col("ref"), F.col("alt"))
    het, hom = _het(F.col("g"))
    ratio = lambda x, y: F.try_divide(F.count_if(x).cast("double"), F.nullif(F.count_if(y).cast("double"), F.lit(0.0)))
    return s.groupBy(*keys).agg(ratio(snv & ti, snv & ~ti).alias("ts_tv"), ratio(het, hom).alias("het_hom"), F.count("*").cast("double").alias("variant_count"))


def as_metrics(wide: DataFrame, names: list[str], keys: list[str] | None = None, sample: str = "all") -> DataFrame:
    """A wide row of metrics as (keys, sample, metric, value) rows."""
    keys = keys or ["run_id"]
    return wide.select(*keys, F.lit(sample).alias("sample"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "sample", "m.*")


def par_mask(calls: DataFrame, build: str | None) -> DataFrame:
    """Calls outside the pseudoautosomal ranges of a build; an unknown build masks nothing. Eight constant ranges, no join."""
    inside = F.lit(False)
    for b, chrom, lo, hi in PAR:
        if b == build:
            inside = inside | (S.chrom_is(F.col("chrom"), chrom) & F.col("pos").between(lo, hi))
    return calls.where(~inside)


def range_mask(calls: DataFrame, ranges: DataFrame, bin_size: int = 1 << 20) -> DataFrame:
    """Calls outside all ranges of a table of any size: chrom, lo, hi, both ends inside; names of chromosomes with and without chr are the same.

    An interval join by bins: a range stands in each bin that it touches, a call in its own, and they meet on chromosome and bin with
    the overlap checked. Ranges are first merged into stretches that don't overlap, so a bin holds few of them. Rows with NULL ends mask nothing.
    """
    name = lambda c: F.regexp_replace(F.lower(c), "^chr", "")
    r = ranges.where("lo <= hi").select(name("chrom").alias("__chrom"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    r = r.select("*", F.explode(F.sequence(F.floor(F.col("lo") / bin_size), F.floor(F.col("hi") / bin_size))).alias("__bin"))
    first, last = F.col("__bin") * bin_size, (F.col("__bin") + 1) * bin_size - 1
    r = r.select("__chrom", "__bin", F.greatest("lo", first).alias("lo"), F.least("hi", last).alias("hi")).distinct()
    w = Window.partitionBy("__chrom", "__bin").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("__new", F.coalesce((F.col("lo") > reach + 1).cast("int"), F.lit(1))).withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.groupBy("__chrom", "__bin", "__part").agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    on = (name("chrom") == F.col("__chrom")) & (F.floor(F.col("pos") / bin_size) == F.col("__bin")) & F.col("pos").between(F.col("__lo"), F.col("__hi"))
    return calls.join(r, on, "left_anti")


def sex_inference(calls: DataFrame, build: str | None, keys: list[str] | None = None, order: list[str] | None = None, least: int = 20) -> DataFrame:
    """X heterozygosity, X sites, Y variants and the sex they tell, one row for each run."""
    keys = keys or ["run_id"]
    s = par_mask(_sites(calls, keys, order or ["line"]), build)
    x = S.chrom_is(F.col("chrom"), "x") & S.biallelic_snv(F.col("ref"), F.col("alt")) & F.col("g").isNotNull() & (F.size(F.split("g", "/")) == 2) & ~F.contains(F.col("g"), F.lit("."))
    het, hom = _het(F.col("g"))
    run = s.groupBy(*keys).agg(F.count_if(x).alias("x_sites"), F.count_if(x & het).alias("x_het"), F.count_if(S.chrom_is(F.col("chrom"), "y")).alias("y_variant_count"))
    ratio = F.when(F.col("x_sites") >= least, F.col("x_het") / F.col("x_sites"))
    sex = (
        F.when(ratio.isNull(), "indeterminate").when(ratio <= 0.10, "XY").when(ratio >= 0.20, F.when(F.col("y_variant_count") >= 5, "discordant").otherwise("XX")).otherwise("discordant")
    )
    return run.select(*keys, "x_sites", ratio.alias("x_het_ratio"), "y_variant_count", sex.alias("inferred_sex"))


def sex_checks(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Two checks: the call, warn at worst, and the informational ratio."""
    keys = keys or ["run_id"]
    call = F.when(F.col("inferred_sex") == "indeterminate", "unverified").when(F.col("inferred_sex") == "discordant", "warn").otherwise("pass")
    ratio = F.when(F.col("x_het_ratio").isNull(), "unverified").otherwise("pass")
    rows = F.array(
        F.struct(F.lit("sex_plausibility").alias("check"), call.alias("status"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("informational")),
        F.struct(F.lit("x_het_ratio").alias("check"), ratio.alias("status"), F.col("x_het_ratio").alias("value"), F.lit(True).alias("informational")),
    )
    return signals.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def median_vaf(vafs: DataFrame, keys: list[str] | None = None, check: str = "median_vaf", low: float | None = 0.05, high: float | None = 0.95) -> DataFrame:
    """Exact median allele fraction of a run's records with its status; records without one don't count in it."""
    keys = keys or ["run_id"]
    run = exact_median(vafs, "vaf", keys, "value").withColumnRenamed("n_rows", "n_records")
    bounds = [F.lit(x).cast("double") for x in (None, low, high, None)]
    return run.select(*keys, F.lit(check).alias("check"), S.band_status(F.col("value"), *bounds).alias("status"), "value", "n_records")


def pon_applied(headers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whether a GATK command line in the header names a panel of normals."""
    keys = keys or ["run_id"]
    gatk = F.startswith(F.col("line"), F.lit("##GATKCommandLine"))
    panel = gatk & F.col("line").rlike(r"--(panel-of-normals|pon)\b")
    run = headers.groupBy(*keys).agg(F.coalesce(F.bool_or(gatk), F.lit(False)).alias("g"), F.coalesce(F.bool_or(panel), F.lit(False)).alias("p"))
    return run.select(*keys, F.when(~F.col("g"), "unverified").when(F.col("p"), "pass").otherwise("warn").alias("status"))


def caller_select(artifacts: DataFrame, first: str, second: str, keys: list[str] | None = None) -> DataFrame:
    """Files of two callers by path component; several or unequal pair folders are unverified, a lone caller makes no row."""
    keys = keys or ["run_id"]
    parts = F.split(F.lower("path"), "/")
    side = F.when(F.array_contains(parts, first), 1).when(F.array_contains(parts, second), 2)
    rows = artifacts.withColumn("side", side).where(F.col("side").isNotNull()).withColumn("pair_dir", F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2))
    dirs = lambda k: F.array_sort(F.collect_set(F.when(F.col("side") == k, F.col("pair_dir"))))
    a = rows.groupBy(*keys).agg(dirs(1).alias("d1"), dirs(2).alias("d2")).where((F.size("d1") > 0) & (F.size("d2") > 0))
    reason = F.when((F.size("d1") > 1) | (F.size("d2") > 1), "several pairs").when(F.col("d1") != F.col("d2"), "pairs differ").otherwise("ok")
    return a.select(*keys, reason.alias("reason"), F.size("d1").alias("n_first"), F.size("d2").alias("n_second"))
