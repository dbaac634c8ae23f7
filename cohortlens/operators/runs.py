"""Runs and their files: differences, benchmarks, integrity, manifests, sheets and visibility."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import MANIFESTS
from ..sources import archives


def run_diff(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Same, changed, added or removed for each (section, key) of two runs. items: run_id, section, key, value; pairs: pair_id, a, b."""
    side = lambda c, n: items.join(pairs.select("pair_id", F.col(c).alias("run_id")), "run_id").select("pair_id", "section", "key", F.col("value").alias(n))
    j = side("a", "value_a").join(side("b", "value_b"), ["pair_id", "section", "key"], "full_outer")
    state = F.when(F.col("value_a").isNull(), "added").when(F.col("value_b").isNull(), "removed").when(F.col("value_a") == F.col("value_b"), "same").otherwise("changed")
    return j.withColumn("state", state)


def reproduced(diff: DataFrame) -> DataFrame:
    """Whether nothing of a pair differs."""
    return diff.groupBy("pair_id").agg(F.count("*").alias("items"), F.count_if(F.col("state") != "same").alias("different"), F.bool_and(F.col("state") == "same").alias("reproduced"))


def benchmark_run(checks: DataFrame, reference: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Each check of a run beside its (pipeline, assay) reference. checks: run_id, pipeline, check, value; reference: pipeline, check, value."""
    want = checks.select("run_id", "pipeline").distinct().join(reference.withColumnRenamed("value", "reference_value"), "pipeline")
    have = checks.select("run_id", "check", F.col("value").alias("run_value"))
    j = want.select("run_id", "check", "reference_value").join(have, ["run_id", "check"], "full_outer")
    delta = S.relative_delta(F.col("run_value"), F.col("reference_value"))
    return j.withColumn("delta", delta).withColumn("within", F.coalesce(delta <= tolerance, F.lit(False)))


def benchmark_summary(compared: DataFrame) -> DataFrame:
    """matched, drifted or no_reference for each run; keys that only one side has are a drift."""
    a = compared.groupBy("run_id").agg(F.count_if("within").alias("matched"), F.count_if(~F.col("within")).alias("drifted"), F.count("reference_value").alias("n"))
    return a.select("run_id", "matched", "drifted", F.when(F.col("n") == 0, "no_reference").when(F.col("drifted") == 0, "match").otherwise("drift").alias("status"))


def reference_upsert(reference: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The reference with the rows of the new keys set or replaced."""
    return reference.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def output_integrity(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Missing and changed files of each run against recorded checksums: counts, the first bad one, and the sorted paths of both."""
    j = recorded.select("run_id", "path", F.col("sha256").alias("was")).join(current.select("run_id", "path", F.col("sha256").alias("now")), ["run_id", "path"], "left")
    gone, other = F.col("now").isNull(), F.col("now") != F.col("was")
    paths = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("path"))))
    a = j.groupBy("run_id").agg(
        F.count_if(gone).alias("missing"), F.count_if(other).alias("changed"), F.min(F.when(gone | other, F.col("path"))).alias("first_bad"), paths(gone).alias("missing_paths"), paths(other).alias("changed_paths")
    )
    return a.withColumn("ok", (F.col("missing") == 0) & (F.col("changed") == 0))


def _glob(pattern: str) -> str:
    return "^" + pattern.replace(".", r"\.").replace("*", ".*") + "$"


def manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, g, r, _glob(g)) for a, g, r in MANIFESTS], "assay string, pattern string, role string, regex string")


def manifest_check(runs: DataFrame, artifacts: DataFrame, expected: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Status of each expected output: required and missing fails, optional and missing warns, an empty file fails.

    counts (run_id, pattern, expected) says how many files a run should have, such as one for each sample: fewer fail, more warn.
    The manifest (a dozen rows) is broadcast; files meet only the patterns of their own run's assay.
    """
    want = runs.select("run_id", "assay").distinct().join(F.broadcast(expected), "assay")
    files = artifacts.join(want.select("run_id", "pattern", "regex"), "run_id").where(F.expr("element_at(split(path, '/'), -1) rlike regex"))
    found = files.groupBy("run_id", "pattern").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    j = want.join(found, ["run_id", "pattern"], "left")
    more = F.lit(None).cast("string")
    if counts is not None:
        j = j.join(counts.select("run_id", "pattern", "expected"), ["run_id", "pattern"], "left")
        n = F.coalesce("n", F.lit(0))
        more = F.when(n < F.col("expected"), "fail").when(n > F.col("expected"), "warn")
    status = F.when(F.col("n").isNull(), F.when(F.col("role") == "required", "fail").otherwise(F.coalesce(more, F.lit("warn")))).when(F.col("least") == 0, "fail").otherwise(F.coalesce(more, F.lit("pass")))
    return j.select("run_id", "pattern", F.coalesce("n", F.lit(0)).alias("n_files"), status.alias("status"))


def index_present(artifacts: DataFrame, of: str = ".bam", index: tuple[str, ...] = (".bai", ".csi")) -> DataFrame:
    """Alignment files without an index beside them."""
    base = artifacts.where(F.endswith("path", F.lit(of))).select("run_id", "path")
    ends = None
    for x in index:
        ends = F.endswith("path", F.lit(x)) if ends is None else ends | F.endswith("path", F.lit(x))
    have = artifacts.where(ends).select("run_id", F.regexp_replace("path", r"\.(bai|csi)$", "").alias("p"))
    have = have.select("run_id", F.when(F.endswith("p", F.lit(of)), F.col("p")).otherwise(F.concat("p", F.lit(of))).alias("path")).distinct()
    return base.join(have.withColumn("has", F.lit(True)), ["run_id", "path"], "left").select("run_id", "path", F.when(F.col("has"), "pass").otherwise("fail").alias("status"))


def archive_integrity(files: DataFrame) -> DataFrame:
    """pass, or why a gzip file is bad: no gzip, truncated or corrupt. files: path, content.

    For contents that are in rows already; files of any size are read by ``sources.archives``, which also looks at end blocks.
    """

    def run(batches):
        for b in batches:
            status = []
            for raw in b.column("content").to_pylist():
                if not raw or raw[:2] != archives.MAGIC:
                    status.append("no gzip")
                else:
                    status.append(archives.stream_fault(lambda: b"", raw) or "pass")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(status, pa.string())], names=["path", "status"])

    return files.select("path", "content").mapInArrow(run, "path string, status string")


def tree_digest(artifacts: DataFrame, exclude: str = ".git") -> DataFrame:
    """sha256 over the sorted 'path NUL sha256' lines of a run's files."""
    files = artifacts.where(~F.array_contains(F.split("path", "/"), exclude))
    lines = F.array_sort(F.collect_list(F.concat("path", F.lit("\x00"), "sha256", F.lit("\n"))))
    return files.groupBy("run_id").agg(F.sha2(F.array_join(lines, ""), 256).alias("tree_sha256"), F.count("*").alias("n_files"))


def input_checksums(artifacts: DataFrame) -> DataFrame:
    """Checksum by base name, with names that stand for several files marked."""
    name = F.element_at(F.split("path", "/"), -1)
    return artifacts.groupBy("run_id", name.alias("name")).agg(F.min("sha256").alias("sha256"), (F.count("*") > 1).alias("ambiguous"))


def samplesheet_validate(rows: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Issues of sample sheets: repeated sample and lane, empty fields, files that don't exist."""
    dup = rows.where(F.coalesce("sample", F.lit("")) != "").groupBy("sheet_id", "sample").count().where("count > 1").select("sheet_id", F.col("sample").alias("at"), F.lit("duplicate sample").alias("issue"))
    empty = rows.where((F.coalesce("sample", F.lit("")) == "") | (F.coalesce("fastq_1", F.lit("")) == "")).select("sheet_id", F.coalesce("sample", F.lit("")).alias("at"), F.lit("empty field").alias("issue"))
    gone = rows.where(F.coalesce("fastq_1", F.lit("")) != "").join(artifacts.select(F.col("path").alias("fastq_1")).distinct(), "fastq_1", "left_anti").select("sheet_id", F.coalesce("sample", F.lit("")).alias("at"), F.lit("missing file").alias("issue"))
    return dup.unionByName(empty).unionByName(gone).distinct()


def tumor_normal_pairing(rows: DataFrame) -> DataFrame:
    """Status other than 0 and 1, and patients with a tumor and no normal."""
    bad = rows.where(~F.coalesce(F.col("status").isin("0", "1"), F.lit(False))).select("patient", F.lit("bad status").alias("issue")).distinct()
    lone = rows.groupBy("patient").agg(F.bool_or(F.col("status") == "1").alias("t"), F.bool_or(F.col("status") == "0").alias("n")).where("t AND NOT n").select("patient", F.lit("no normal").alias("issue"))
    return bad.unionByName(lone)


def visible_runs(runs: DataFrame, viewer: str, workspaces: list[str], admin: bool = False) -> DataFrame:
    """Runs a viewer may see: their own, those of their workspaces, all for an admin."""
    return runs if admin else runs.where((F.col("owner") == viewer) | F.col("workspace").isin(workspaces))


def reference_identity(parameters: DataFrame, artifacts: DataFrame) -> DataFrame:
    """igenomes key, or explicit FASTA and GTF with their checksums, or none. parameters: run_id, genome, fasta, gtf."""
    sha = artifacts.select("run_id", "path", "sha256")
    df = parameters.join(sha.select("run_id", F.col("path").alias("fasta"), F.col("sha256").alias("fasta_sha")), ["run_id", "fasta"], "left")
    df = df.join(sha.select("run_id", F.col("path").alias("gtf"), F.col("sha256").alias("gtf_sha")), ["run_id", "gtf"], "left")
    kind = F.when(F.col("genome").isNotNull(), "igenomes").when(F.col("fasta").isNotNull(), "explicit").otherwise("none")
    return df.select("run_id", kind.alias("kind"), "genome", "fasta_sha", "gtf_sha")


def rocrate(runs: DataFrame, files: DataFrame, qc: DataFrame | None = None) -> DataFrame:
    """run_id and document: the JSON-LD of a crate for each run, whose @graph is an array of descriptor, root, application, input and output files, in this order.

    runs: run_id, and as far as there are such columns pipeline, pipeline_revision, verdict and parameters (a map); files: run_id, path, sha256, and role (input, else
    output); qc: run_id, check, status, value. Entities differ in shape, so each is a variant. Files come by path and checks by name, so that a
    run's document is the same each time.
    """
    has = lambda df, c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    of = lambda r: F.when(F.coalesce(has(files, "role"), F.lit("output")) == r, F.struct(F.col("path").alias("@id"), F.lit("File").alias("@type"), F.col("sha256")))
    parts = files.groupBy("run_id").agg(*[F.array_sort(F.collect_set(of(r))).alias(f"__{r}") for r in ("input", "output")])
    df = runs.join(parts, "run_id", "left")
    results = "array<struct<`check`:string,status:string,value:double>>"
    if qc is not None:
        df = df.join(qc.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("check", "status", F.col("value").cast("double").alias("value")))).alias("__qc")), "run_id", "left")
    else:
        df = df.withColumn("__qc", F.lit(None).cast(results))
    none = F.array().cast("array<struct<`@id`:string,`@type`:string,sha256:string>>")
    inputs, outputs = F.coalesce("__input", none), F.coalesce("__output", none)
    pipeline = has(df, "pipeline")
    sorted_map = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(has(df, "parameters", "map<string,string>"), F.create_map().cast("map<string,string>")))))
    link = lambda c: F.struct(c.alias("@id"))
    entity = lambda *c: F.parse_json(F.to_json(F.struct(*c)))
    descriptor = entity(F.lit("ro-crate-metadata.json").alias("@id"), F.lit("CreativeWork").alias("@type"), link(F.lit("https://w3id.org/ro/crate/1.1")).alias("conformsTo"), link(F.lit("./")).alias("about"))
    root = entity(
        F.lit("./").alias("@id"), F.lit("Dataset").alias("@type"), F.col("run_id").alias("identifier"), F.concat(F.lit("run "), "run_id").alias("name"), F.when(pipeline.isNotNull(), link(pipeline)).alias("mainEntity"),
        F.transform(F.concat(inputs, outputs), lambda f: link(f["@id"])).alias("hasPart"), has(df, "verdict").alias("verdict"), sorted_map.alias("parameters"), F.coalesce("__qc", F.array().cast(results)).alias("qcResults"),
    )
    application = F.when(pipeline.isNotNull(), entity(pipeline.alias("@id"), F.lit("SoftwareApplication").alias("@type"), pipeline.alias("name"), has(df, "pipeline_revision").alias("version")))
    entities = F.concat(F.array_compact(F.array(descriptor, root, application)), F.transform(F.concat(inputs, outputs), lambda f: F.parse_json(F.to_json(f))))
    return df.select("run_id", F.to_json(F.struct(F.lit("https://w3id.org/ro/crate/1.1/context").alias("@context"), entities.alias("@graph"))).alias("document"))
