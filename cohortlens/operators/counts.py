"""Gene counts of two tools: collapse to genes, ranks and concordance, for all runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import average_rank


def collapse_to_gene(transcripts: DataFrame, t2g: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Transcript counts summed by gene; transcripts without a gene are left out."""
    keys = keys or ["run_id"]
    return transcripts.join(t2g, "transcript_id").groupBy(*keys, "gene_id").agg(F.sum("est_counts").alias("count"))


def count_concordance(a: DataFrame, b: DataFrame, keys: list[str] | None = None, least: int = 10) -> DataFrame:
    """Spearman correlation, fraction agreeing within 10 %, and gene overlap of two tools' counts.

    A constant side has no correlation, which is unverified; sums are used because corr() divides by zero there.
    """
    keys = keys or ["run_id"]
    tag = lambda df, side: df.select(*keys, "gene_id", F.col("count").cast("double").alias("count"), F.lit(side).alias("side"))
    pick = lambda side: F.sum(F.when(F.col("side") == side, F.col("count")))
    gene = tag(a, 1).unionByName(tag(b, 2)).groupBy(*keys, "gene_id").agg(pick(1).alias("x"), pick(2).alias("y"))
    both = gene.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("v")) for k, c in ((1, "x"), (2, "y"))])
    long = average_rank(both.select(*keys, "gene_id", F.explode(sides).alias("s")).select(*keys, "gene_id", "s.*"), "v", [*keys, "side"], "r")
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c)))
    ranked = long.groupBy(*keys, "gene_id").agg(of(1, "v").alias("x"), of(2, "v").alias("y"), of(1, "r").alias("rx"), of(2, "r").alias("ry"))
    agree = F.abs(F.col("x") - F.col("y")) / F.greatest("x", "y", F.lit(1.0)) <= 0.10
    n = F.count("*").cast("double")
    sxy, sx, sy = F.sum(F.col("rx") * F.col("ry")), F.sum("rx"), F.sum("ry")
    sxx, syy = F.sum(F.col("rx") * F.col("rx")), F.sum(F.col("ry") * F.col("ry"))
    run = ranked.groupBy(*keys).agg(
        F.count("*").alias("shared"), (n * sxy - sx * sy).alias("cov"), ((n * sxx - sx * sx) * (n * syy - sy * sy)).alias("var"), F.count_if(agree).alias("n_agree")
    )
    union = gene.groupBy(*keys).agg(F.count("*").alias("n_union"))
    rho = F.when(F.col("var") > 0, F.round(F.col("cov") / F.sqrt("var"), 12))
    out = union.join(run, keys, "left").select(*keys, F.coalesce("shared", F.lit(0)).alias("shared"), "n_union", rho.alias("rho"), (F.col("n_agree") / F.col("shared")).alias("fraction_agreeing"))
    few = F.col("shared") < least
    status = lambda c: F.when(few | F.col(c).isNull(), "unverified").when(F.col(c) < 0.90, "warn").otherwise("pass")
    return out.withColumn("overlap", F.col("shared") / F.col("n_union")).withColumn("rho_status", status("rho")).withColumn("agree_status", status("fraction_agreeing"))
