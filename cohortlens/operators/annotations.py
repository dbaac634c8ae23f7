"""Annotated call sets: agreement of two annotators, completeness and plausibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .variants import SITE


def _sides(a: DataFrame, b: DataFrame, value: Column, keys: list[str], order: list[str], known: bool = False) -> DataFrame:
    """x and y: the value of a site's last row on either side, or of its last row with a value. Both sides are tagged and united, so that one shuffle does."""
    tag = lambda df, k: df.select(*keys, *SITE, F.struct(*order).alias("__o"), value.alias("__v"), F.lit(k).alias("__side"))
    both = tag(a, 1).unionByName(tag(b, 2))
    counts = F.col("__v").isNotNull() if known else F.lit(True)  # a filter would go below the projection and compute the value twice
    pick = lambda k: F.max_by(F.struct("__v"), F.when((F.col("__side") == k) & counts, F.col("__o")))["__v"]
    return both.groupBy(*keys, *SITE).agg(pick(1).alias("x"), pick(2).alias("y"))


def consequence_concordance(a: DataFrame, b: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, least: int = 10) -> DataFrame:
    """Agreement of the most severe terms at shared sites; unverified under ``least`` shared, warn under 0.90.

    The most severe term of a site is that of its last row with any: a later duplicate without terms doesn't replace an earlier one.
    """
    keys, order = keys or ["run_id"], order or ["line"]
    term = S.most_severe(S.variant_terms(F.col("ann"), F.col("idx")))
    site = _sides(a, b, term, keys, order, known=True).where("x IS NOT NULL OR y IS NOT NULL")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    run = site.groupBy(*keys).agg(F.count_if(both).alias("shared"), F.count_if(F.col("x") == F.col("y")).alias("matches"))
    return _agreement(run, least, False)


def symbol_concordance(a: DataFrame, b: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, least: int = 10) -> DataFrame:
    """Agreement of gene symbols where both have one; informational."""
    keys, order = keys or ["run_id"], order or ["line"]
    site = _sides(a, b, S.symbol(F.col("ann"), F.col("sym_idx")), keys, order).where("x IS NOT NULL AND y IS NOT NULL")
    run = site.groupBy(*keys).agg(F.count("*").alias("shared"), F.count_if(F.col("x") == F.col("y")).alias("matches"))
    return _agreement(run, least, True)


def _agreement(run: DataFrame, least: int, informational: bool) -> DataFrame:
    rate = F.when(F.col("shared") > 0, F.col("matches") / F.col("shared"))
    verdict = F.lit("pass") if informational else F.when(rate < 0.90, "warn").otherwise("pass")
    return run.withColumn("agreement", rate).withColumn("status", F.when(F.col("shared") < least, "unverified").otherwise(verdict)).withColumn("informational", F.lit(informational))


def annotation_layout(headers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How a run's annotators lie: one file with both, one file each, one annotator, or several files (ambiguous)."""
    keys = keys or ["run_id"]
    file = headers.groupBy(*keys, "path").agg(F.bool_or(F.startswith("line", F.lit("##INFO=<ID=CSQ"))).alias("csq"), F.bool_or(F.startswith("line", F.lit("##INFO=<ID=ANN"))).alias("ann"))
    run = file.groupBy(*keys).agg(
        F.min(F.when(F.col("csq") & F.col("ann"), F.col("path"))).alias("both"),
        F.count_if(F.col("csq")).alias("n_csq"),
        F.count_if(F.col("ann")).alias("n_ann"),
        F.min(F.when(F.col("csq"), F.col("path"))).alias("vep"),
        F.min(F.when(F.col("ann"), F.col("path"))).alias("snpeff"),
    )
    layout = (
        F.when(F.col("both").isNotNull(), "single").when((F.col("n_csq") == 0) & (F.col("n_ann") == 0), "none").when((F.col("n_csq") == 0) | (F.col("n_ann") == 0), "one_annotator")
        .when((F.col("n_csq") > 1) | (F.col("n_ann") > 1), "ambiguous").otherwise("split")
    )
    return run.select(*keys, layout.alias("layout"), F.coalesce("both", "vep").alias("vep_path"), F.coalesce("both", "snpeff").alias("snpeff_path"))


def annotation_structural(records: DataFrame, keys: list[str] | None = None, info: str = "ann") -> DataFrame:
    """Share of records with an annotation: all pass, fewer warn, no record unverified."""
    keys = keys or ["run_id"]
    run = records.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.col(info), F.lit("")) != "").alias("annotated"))
    value = F.when(F.col("annotated") > 0, F.col("annotated") / F.col("total"))
    return run.select(*keys, "total", "annotated", value.alias("value"), F.when(value.isNull(), "unverified").when(value == 1.0, "pass").otherwise("warn").alias("status"))


def annotation_metrics(records: DataFrame, keys: list[str] | None = None, info: str = "ann", index: str = "idx") -> DataFrame:
    """Share of real and of intergenic consequences among annotated records; a record without terms counts below the line only."""
    keys = keys or ["run_id"]
    r = records.where(F.coalesce(F.col(info), F.lit("")) != "").withColumn("term", S.most_severe(S.variant_terms(F.col(info), F.col(index))))
    rank = S.severity_rank(F.col("term"))
    run = r.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("term").isNotNull() & (rank > 0)).alias("real"), F.count_if(F.col("term").isNotNull() & (rank == 0)).alias("inter"))
    return run.select(*keys, (F.col("real") / F.col("n")).alias("real_consequence_fraction"), (F.col("inter") / F.col("n")).alias("intergenic_fraction"))


def annotation_identity(headers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tool, version and cache of the first header line of each annotator in path order."""
    keys = keys or ["run_id"]
    line = F.col("line")
    tool = F.when(F.startswith(line, F.lit("##VEP=")), "VEP").when(F.startswith(line, F.lit("##SnpEffVersion=")), "SnpEff")
    version = F.regexp_extract(line, r'=\"?v?([0-9][0-9A-Za-z._]*)', 1)
    cache = F.regexp_extract(line, r'cache=\"([^\"]*)\"', 1)
    rows = headers.withColumn("tool", tool).where(F.col("tool").isNotNull())
    return rows.groupBy(*keys, "tool").agg(F.min_by(F.struct(version.alias("version"), cache.alias("cache")), F.struct("path", "line")).alias("i")).select(*keys, "tool", "i.version", "i.cache")


def corroboration_line(consequence: DataFrame, symbols: DataFrame, identity: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """One sentence for each run on how far two annotators agree; NULL where consequences could not be compared.

    consequence and symbols are the results of the two concordances; identity (tool of each run) names the annotators.
    """
    keys = keys or ["run_id"]
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("matches", "shared", "agreement")])
    df = side(consequence, "c").join(side(symbols, "s"), keys, "left")
    names = F.lit(None).cast("string")
    if identity is not None:
        tools = identity.where(F.col("tool") != "").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("tool")), " and ").alias("__names"))
        df, names = df.join(tools, keys, "left"), F.col("__names")
    # a share that lies halfway in binary too, an odd number of eighths, goes to the even hundredth
    halfway = lambda c: F.when(F.col(c) * 8 == F.floor(F.col(c) * 8), F.bround(c, 2)).otherwise(F.col(c))
    genes = F.format_string("; gene symbols %d/%d (%.2f, informational)", "s_matches", "s_shared", halfway("s_agreement"))
    line = F.concat(
        F.lit("Corroborated by "), F.coalesce(names, F.lit("the two annotators")), F.format_string(": %d/%d consequences agree (%.2f)", "c_matches", "c_shared", halfway("c_agreement")),
        F.when(F.col("s_agreement").isNotNull(), genes).otherwise(""), F.lit("."),
    )
    return df.select(*keys, F.when(F.col("c_agreement").isNotNull(), line).alias("line"))
