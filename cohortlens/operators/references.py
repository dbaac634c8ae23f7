"""Sequence names of references: consistency, aliases and the renaming that makes a GTF fit a FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sequence_consistency(fasta: DataFrame, gtf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """ok if either side is empty or any name is shared, else mismatch, with a hint if only a chr prefix differs."""
    keys = keys or ["run_id"]
    side = lambda df, k: df.select(*keys, "name", F.lit(k).alias("side"))
    names = side(fasta, 1).unionByName(side(gtf, 2)).groupBy(*keys, "name").agg(F.bit_or("side").alias("s"))
    bare = lambda k: F.count_if((F.col("s") == k) & F.startswith("name", F.lit("chr")))
    run = names.groupBy(*keys).agg(F.count_if(F.col("s") == 3).alias("shared"), F.count_if(F.col("s").isin(1, 3)).alias("nf"), F.count_if(F.col("s").isin(2, 3)).alias("ng"), bare(1).alias("cf"), bare(2).alias("cg"))
    bad = (F.col("nf") > 0) & (F.col("ng") > 0) & (F.col("shared") == 0)
    hint = F.when(bad & (F.col("cf") > 0) & (F.col("cg") == 0), "add chr").when(bad & (F.col("cf") == 0) & (F.col("cg") > 0), "strip chr")
    return run.select(*keys, "shared", F.when(bad, "mismatch").otherwise("ok").alias("issue"), hint.alias("hint"))


def alias_table(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name -> group of alias pairs (a, b), and the names that stand in several groups; the group is its smallest name."""
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    rows = p.select(F.explode(F.array("a", "b")).alias("name"), F.col("a").alias("grp")).distinct()
    counts = rows.groupBy("name").agg(F.count_distinct("grp").alias("n"), F.min("grp").alias("grp"))
    return counts.where("n = 1").select("name", "grp"), counts.where("n > 1").select("name")


def harmonize_plan(fasta: DataFrame, gtf: DataFrame, aliases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """New name and direction of each GTF sequence that has none of its own in the FASTA.

    Candidates: with or without chr, and the same for all of its alias group. The name itself is kept if the
    FASTA has it, else the smallest candidate there. A run's plan is dropped unless it adds shared names and no two names
    become one.
    """
    keys = keys or ["run_id"]
    strip = F.regexp_replace("name", "^chr", "")
    variants = F.array_distinct(F.array("name", strip, F.concat(F.lit("chr"), strip)))
    g = gtf.select(*keys, "name").distinct()
    grown = g.select(*keys, F.col("name").alias("old"), F.explode(variants).alias("name"))
    named = grown.join(aliases, "name").select(*keys, "old", "grp").distinct().join(aliases, "grp").select(*keys, "old", "name")
    again = named.select(*keys, "old", F.explode(variants).alias("name"))
    cand = grown.unionByName(again).distinct().join(fasta.select(*keys, "name").distinct(), [*keys, "name"])
    best = cand.groupBy(*keys, "old").agg(F.max((F.col("name") == F.col("old")).cast("int")).alias("own"), F.min("name").alias("low"))
    best = best.select(*keys, "old", F.when(F.col("own") == 1, F.col("old")).otherwise(F.col("low")).alias("new_name"))
    ok = best.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("new_name").alias("d"), F.count_if(F.col("old") != F.col("new_name")).alias("moved")).where("n = d AND moved > 0").select(*keys)
    add = F.col("new_name") == F.concat(F.lit("chr"), F.col("old"))
    cut = F.col("old") == F.concat(F.lit("chr"), F.col("new_name"))
    plan = best.where("old <> new_name").join(ok, keys)
    return plan.select(*keys, F.col("old").alias("name"), "new_name", F.when(add, "add_chr").when(cut, "strip_chr").otherwise("alias").alias("direction"))


def harmonize_rows(lines: DataFrame, plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """GTF lines with column 1 renamed; comments and lines without a tab stay as they are."""
    keys = keys or ["run_id"]
    first = F.when(~F.startswith("line", F.lit("#")) & F.contains(F.col("line"), F.lit("\t")), F.substring_index("line", "\t", 1))
    j = lines.withColumn("name", first).join(plan.select(*keys, "name", "new_name"), [*keys, "name"], "left")
    renamed = F.concat(F.col("new_name"), F.expr("substring(line, length(name) + 1)"))
    return j.select(*keys, "line_no", F.coalesce(renamed, F.col("line")).alias("line"))


def unmatched(fasta: DataFrame, gtf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = [*(keys or ["run_id"]), "name"]
    return gtf.select(*keys).distinct().join(fasta.select(*keys).distinct(), keys, "left_anti")
