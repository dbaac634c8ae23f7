"""Line dedup: lines that many documents share go, except in one document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WS, ascii_lower, stage


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(WS)))


def _hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes, so that keys stay apart at any corpus size."""
    return [F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit(1), key).alias("__h2")]


def drop_common_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``docs`` with the lines gone whose key stands in ``min_docs`` documents or more.

    A key is the line without ASCII white space at both ends, A-Z lower-cased; keys under ``min_chars``
    code points never count. The largest id that holds a key keeps its lines. Adds ``n_lines`` and
    ``n_dropped`` (they replace columns of these names). Rows of one id are one document; a null text is one
    empty line and stays null; rows with a null id count for nothing and keep all lines; empty input
    gives empty output.

    Keys travel as two hashes, aggregated on the map side, so a line that a third of all documents holds
    costs a row per task. The few common keys are staged, so the join back sees their size; beyond the
    broadcast threshold it is a sort-merge join that adaptive execution can split. Text moves once.
    """
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.explode(F.split(text_col, "\n")).alias("__line")
    )
    keys = lines.select("__id", F.trim("__line", F.lit(WS)).alias("__line")).where(F.length("__line") >= min_chars)
    held = keys.select("__id", *_hashes(ascii_lower(F.col("__line")))).distinct()
    common = stage(
        held.groupBy("__h1", "__h2").agg(F.count("*").alias("__n"), F.max("__id").alias("__keeper")).where(F.col("__n") >= min_docs),
        "common_lines",
    )
    gone = (
        held.join(common.select("__h1", "__h2", "__keeper"), ["__h1", "__h2"])
        .where(F.col("__id") != F.col("__keeper"))
        .groupBy(F.col("__id").alias("__gid"))
        .agg(F.collect_list(F.struct("__h1", "__h2")).alias("__gone"))
    )
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    kept = F.filter("__lines", lambda x: ~F.array_contains("__gone", F.struct(*_hashes(line_key(x)))))
    joined = docs.drop("n_lines", "n_dropped").join(gone, F.col(id_col) == F.col("__gid"), "left")
    out = joined.withColumn("__lines", split).withColumn("__kept", F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(kept))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    return (
        out.withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dropped", (F.size("__lines") - F.size("__kept")).cast("long"))
        .withColumn(text_col, text)
        .drop("__lines", "__kept", "__gone", "__gid")
    )
