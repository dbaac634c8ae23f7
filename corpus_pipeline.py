"""From raw documents to tokens: five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, langid, lines, minhash, mixing
from cohortlens.llm.base import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if it has no letters or no language reaches this share of the posterior.
MIN_SCORE = 0.9
MIX = {"domain": {"d0": 4, "d1": 3, "d2": 3, "d3": 3}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 4}, "default": 1}
BUDGET_SHARE = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a clear language; ``lang`` becomes the predicted one."""
    out = langid.predict(docs, langid.fit(docs))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share."""
    return lines.drop_common_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fit the budgets of the weights, of one epoch."""
    return mixing.mix_sources(docs, MIX, BUDGET_SHARE, max_epochs=1.0).where(F.col("copies") > 0).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the round trip."""
    return bpe.digests(docs, keep_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("byte_bpe", tokenize)]

#: Stages 1, 3 and 5 can't be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Each one's documents are written once and read again, as a stage may read its input several times."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline_{name}")
    return docs
