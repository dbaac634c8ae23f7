"""Writers: records, snapshots, cases and rewritten reference files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, runs


def write_records(records: DataFrame, path: str) -> None:
    """One JSON document for each run, in a folder for each."""
    records.withColumn("run", F.col("run_id")).write.mode("overwrite").partitionBy("run").json(path)


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("append").json(path)


def append_cases(new: DataFrame, path: str, schema: str) -> None:
    """Append cases whose id isn't in the table yet."""
    pending = new.sparkSession.read.schema(schema).json(path)
    corpus.append_new_cases(pending, new).write.mode("append").json(path)


def write_gtf(lines: DataFrame, path: str) -> None:
    """Lines in order of their numbers; ranges of lines are sorted apart, and carriage returns stay."""
    lines.repartitionByRange("run_id", "line_no").sortWithinPartitions("run_id", "line_no").select("run_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("run_id").option("lineSep", "\n").text(path)


def write_rocrate(of_runs: DataFrame, files: DataFrame, path: str) -> None:
    runs.rocrate(of_runs, files).write.mode("overwrite").partitionBy("run_id").text(path)
