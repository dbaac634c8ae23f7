"""Readers of the files of many runs at once. Run and sample come from the path; nothing is parsed one file at a time.

A path that ends in .parquet is a table of small files, see ``archives.packed``, for cohorts with more files than a file system lists and opens in good time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.tables import CHRX_LENGTH
from ..operators.variants import SITE
from . import archives


def _text(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Lines with their file, the run (first folder under ``runs``, else the parent) and an order within the file."""
    if archives.is_pack(path):
        return _packed_text(spark, path, whole)
    raw = spark.read.text(path, wholetext=whole, recursiveFileLookup=True)
    file = F.col("_metadata.file_path")
    return raw.select(_run(file).alias("run_id"), file.alias("path"), F.col("_metadata.file_name").alias("file_name"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("id")).alias("line"), F.col("value"))


def _run(file: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(file, r"/runs/(?:run_id=)?([^/]+)/", 1), F.lit("")), F.regexp_extract(file, r"/([^/]+)/[^/]+$", 1))


def _packed_text(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """``_text`` of a table of small files: a line ends as in Spark's reader, and the last one may lack its end."""
    files = archives.packed(spark, path).where("length > 0").select("path", F.col("content").cast("string").alias("value"))
    if whole:
        rows = files.select("path", F.lit(0).cast("long").alias("id"), "value")
    else:
        lines = F.split("value", "\r\n|[\r\n]")
        n = F.size(lines) - (F.element_at(lines, -1) == "").cast("int")
        rows = files.select("path", F.posexplode(F.slice(lines, F.lit(1), n)).alias("id", "value"))
    line = F.struct(F.lit(0).cast("long").alias("file_block_start"), F.col("id").cast("long").alias("id"))
    return rows.select(_run(F.col("path")).alias("run_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), line.alias("line"), "value")


def runs(spark: SparkSession, path: str, name: str = "run_record.json") -> DataFrame:
    """All files of that name under a folder, sorted by id; annotation_identity as a list whatever old records hold."""
    schema = "run_id string, pipeline string, pipeline_revision string, assay string, status string, parameters variant, annotation_identity variant, input_checksums map<string,string>, output_checksums map<string,string>"
    df = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter=name)
    kind = F.schema_of_variant("annotation_identity")
    as_list = F.when(F.col("annotation_identity").isNull() | (kind == "VOID"), F.array().cast("array<string>")).when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get("annotation_identity", "$", "array<string>")).otherwise(F.array(F.to_json("annotation_identity")))
    return df.withColumn("annotation_identity", as_list).orderBy("run_id")


def jsonl(spark: SparkSession, path: str, schema: str, required: list[str] = (), strict: bool = False) -> DataFrame:
    """JSON lines: strict fails at any bad line, else bad lines and rows without the required fields are left out."""
    df = spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")
    for c in required:
        df = df.where(F.col(c).isNotNull())
    return df


def _table(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """Rows as maps from the header of their own file; the first line of a file is its header."""
    first = lines.groupBy("path").agg(F.min_by("value", "line").alias("header"), F.min("line").alias("top"))
    cells = F.split("value", sep)
    names = F.transform(F.split("header", sep), lambda c: F.trim(c))
    zipped = F.transform(F.arrays_zip(names.alias("k"), cells.alias("v")), lambda z: F.struct(z["k"].alias("k"), z["v"].alias("v")))
    pairs = F.map_from_entries(F.array_distinct(F.transform(F.arrays_zip(names.alias("k"), cells.alias("v")), lambda z: F.struct(z["k"], z["v"]))))
    rows = lines.join(first, "path").where((F.col("line") > F.col("top")) & (F.trim("value") != ""))
    return rows.select("run_id", "path", "file_name", "line", pairs.alias("row"), zipped.alias("cells"))


def _get(name: str) -> Column:
    v = F.trim(F.try_element_at("row", F.lit(name)))
    return F.when(~v.isin("", "-"), v)


def _from(cells: Column | str, start: int) -> Column:
    """The cells of a row from the start-th (from 1) to its end."""
    return F.slice(cells, start, F.greatest(F.size(cells) - (start - 1), F.lit(0)))


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Task rows with usage; columns are found by header name, absent ones are NULL, and the process is the name column."""
    t = _table(_text(spark, path))
    return t.select(
        "run_id", _get("task_id").alias("task_id"), _get("name").alias("process"), _get("status").alias("status"), _get("exit").try_cast("int").alias("exit_code"),
        S.duration_sec(_get("realtime")).alias("realtime_sec"), S.size_mb(_get("peak_rss")).alias("peak_rss_mb"), S.pct_cpu(_get("%cpu")).alias("pct_cpu"),
    )


def snakemake(spark: SparkSession, path: str) -> DataFrame:
    """A completed task for each rule of a stats file."""
    t = _text(spark, path, whole=True)
    rules = F.map_keys(F.from_json("value", "rules map<string,string>", {"mode": "FAILFAST"})["rules"])
    return t.select("run_id", F.explode(rules).alias("process"), F.lit("COMPLETED").alias("status"), F.lit(0).alias("exit_code"))


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """Calls of at least five columns: site, filter, info, format, samples and the first sample's genotype."""
    c = F.split("value", "\t")
    rows = _text(spark, path).where(~F.startswith("value", F.lit("#"))).withColumn("c", c).where(F.size("c") >= 5)
    at = F.array_position(F.split(F.get("c", F.lit(8)), ":"), "GT")
    gt = F.when(at > 0, F.get(F.split(F.get("c", F.lit(9)), ":"), (at - 1).cast("int")))
    return rows.select(
        "run_id", "path", "line", F.col("c")[0].alias("chrom"), F.col("c")[1].try_cast("long").alias("pos"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt"),
        F.trim(F.get("c", F.lit(6))).alias("filter"), F.get("c", F.lit(7)).alias("info"), F.get("c", F.lit(8)).alias("format"), _from("c", 10).alias("samples"), gt.alias("gt"),
    )


def vcf_pass(spark: SparkSession, path: str) -> DataFrame:
    return vcf(spark, path).where(F.col("filter").isin("PASS", ".")).select("run_id", *SITE).distinct()


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: sample columns of tumor and normal, CSQ subfield indexes, declared keys, build, GATK lines."""
    h = _text(spark, path).where(F.startswith("value", F.lit("#")))
    v = F.col("value")
    named = lambda k: F.max(F.nullif(F.regexp_extract(v, rf"^##{k}=(.+)$", 1), F.lit("")))
    a = h.groupBy("run_id", "path").agg(
        named("tumor_sample").alias("tumor"), named("normal_sample").alias("normal"), F.max(F.when(F.startswith(v, F.lit("#CHROM")), v)).alias("columns"),
        F.max(F.nullif(F.regexp_extract(v, r"^##INFO=<ID=CSQ.*Format: ([^\">]+)", 1), F.lit(""))).alias("csq"), F.bool_or(F.startswith(v, F.lit("##INFO=<ID=ANN"))).alias("has_ann"),
        F.max(F.nullif(F.regexp_extract(v, r"^##contig=<ID=(?:chr)?X,length=([0-9]+)", 1), F.lit(""))).alias("x_length"), F.array_sort(F.collect_list(F.when(F.startswith(v, F.lit("##GATKCommandLine")), v))).alias("gatk"),
    )
    place = lambda c: F.nullif(F.array_position(_from(F.split("columns", "\t"), 10), F.col(c)), F.lit(0)) - 1
    index = lambda n: F.nullif(F.array_position(F.split("csq", "[|]"), n), F.lit(0)) - 1
    build = F.lit(None).cast("string")
    for length, name in CHRX_LENGTH.items():
        build = F.when(F.col("x_length") == length, name).otherwise(build)
    return a.select("run_id", "path", place("tumor").alias("tumor_at"), place("normal").alias("normal_at"), index("Consequence").alias("consequence_at"), index("SYMBOL").alias("symbol_at"), F.col("csq").isNotNull().alias("has_csq"), "has_ann", build.alias("build"), "gatk")


def count_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Gene counts: the sum of each row's numeric cells; rows without any (such as the header) go, repeated ids add up."""
    return _dense(_text(spark, path), sep)


def _dense(lines: DataFrame, sep: str = "\t") -> DataFrame:
    c = F.split("value", sep)
    values = F.filter(F.transform(_from(c, 2), lambda x: S.number(x)), lambda x: x.isNotNull())
    rows = lines.select("run_id", "path", F.trim(c[0]).alias("gene_id"), values.alias("v")).where(F.size("v") > 0)
    return rows.groupBy("run_id", "path", "gene_id").agg(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("count"))


#: Bits of what can be wrong with a matrix file, and the reason that is told, of the lowest bit that is set.
MATRIX_FAULTS = ["empty file", "no dimensions", "square matrix, features can't be told from cells", "no feature list", "no dimension as long as the feature list", "index out of range", "line without three numbers"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All files under a folder, empty ones included, without their contents."""
    return archives.files(spark, path).select(_run(F.col("path")).alias("run_id"), "path", F.element_at(F.split("path", "/"), -1).alias("file_name"))


def mtx(spark: SparkSession, path: str, features: str) -> DataFrame:
    """MatrixMarket triplets as gene totals; the feature axis is the dimension as long as the feature list. Files with a fault give nothing, see ``matrices``."""
    return _totals(_triplets(_files(spark, path), _text(spark, path), _text(spark, features)))


def sc_matrix(spark: SparkSession, path: str, features: str) -> DataFrame:
    """Gene totals of single-cell matrices, of files without a fault."""
    return _totals(matrices(spark, path, features))


def _totals(found: DataFrame) -> DataFrame:
    return found.where(F.col("fault").isNull()).groupBy("run_id", "gene_id").agg(F.sum("count").alias("count"))


def matrices(spark: SparkSession, path: str, features: str) -> DataFrame:
    """run_id, path, gene_id, count, fault: a row for each gene of a sound matrix, or one row with the fault of one that can't be used.

    Files named .mtx or .mtx.gz are triplets, all others dense tables, whose only fault is to have no counts.
    """
    lines, files = _text(spark, path), _files(spark, path)
    sparse = F.col("file_name").rlike(r"\.mtx(\.gz)?$")
    dense = _dense(lines.where(~sparse)).select("run_id", "path", "gene_id", "count")
    dense = files.where(~sparse).select("run_id", "path").join(dense, ["run_id", "path"], "left").withColumn("fault", F.when(F.col("gene_id").isNull(), MATRIX_FAULTS[0]))
    return _triplets(files.where(sparse), lines.where(sparse), _text(spark, features)).unionByName(dense)


def matrix_errors(found: DataFrame) -> DataFrame:
    """Runs with a matrix that can't be used, and why."""
    return found.where(F.col("fault").isNotNull()).groupBy("run_id").agg(F.min("fault").alias("reason"))


def _triplets(files: DataFrame, lines: DataFrame, features: DataFrame) -> DataFrame:
    """Sums by gene beside a set of faults by file: both are aggregated from the same lines and meet in one join from the list of files."""
    lines = lines.where(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    n = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: S.number(x))
    rows = lines.select("run_id", "path", "line", n.alias("n"))
    top = rows.groupBy("path").agg(F.min_by("n", "line").alias("dims"), F.min("line").alias("top"))
    names = features.where(F.trim("value") != "").select("run_id", "path", "line", F.split("value", "\t")[0].alias("gene_id"))
    names = names.withColumn("idx", F.row_number().over(Window.partitionBy("run_id", "path").orderBy("line"))).drop("path", "line")
    size = names.groupBy("run_id").agg(F.max("idx").alias("n_features"))
    head = top.withColumn("sound", (F.size("dims") >= 3) & F.col("dims")[0].isNotNull() & F.col("dims")[1].isNotNull())
    file = files.select("run_id", "path").join(head, "path", "left").join(size, "run_id", "left")
    d0, d1 = F.when(F.col("sound"), F.get("dims", F.lit(0))), F.when(F.col("sound"), F.get("dims", F.lit(1)))
    axis = F.when(d0 == F.col("n_features"), 0).when(d1 == F.col("n_features"), 1)
    known = [F.col("top").isNull(), F.col("top").isNotNull() & ~F.coalesce("sound", F.lit(False)), d0 == d1, F.col("n_features").isNull(), F.col("n_features").isNotNull() & axis.isNull() & d0.isNotNull()]
    bits = lambda conditions, start: sum((F.when(F.coalesce(c, F.lit(False)), 1 << (start + i)).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    file = file.select("run_id", "path", "top", d0.alias("d0"), d1.alias("d1"), axis.alias("axis"), "n_features", bits(known, 0).alias("faults"))
    body = rows.drop("run_id").join(file, "path").where("line > top")
    i, j, v = (F.get("n", F.lit(k)) for k in range(3))
    blank = i.isNull() | j.isNull() | v.isNull()
    out = ~blank & ((i < 1) | (i > F.col("d0")) | (j < 1) | (j > F.col("d1")) | (i != F.floor(i)) | (j != F.floor(j)))
    idx = F.when(F.col("axis") == 0, i).otherwise(j).cast("int")
    sums = body.groupBy("run_id", "path", F.when(~blank & ~out, idx).alias("idx")).agg(F.sum(F.when(~blank & ~out, v)).alias("count"), F.bit_or(bits([out, blank], 5)).alias("bits"))
    told = sums.groupBy("run_id", "path").agg(F.bit_or("bits").alias("bits"))
    file = file.join(told, ["run_id", "path"], "left").select("run_id", "path", F.col("faults").bitwiseOR(F.coalesce("bits", F.lit(0))).alias("faults"))
    reason = F.lit(None).cast("string")
    for k in reversed(range(len(MATRIX_FAULTS))):
        reason = F.when(F.col("faults").bitwiseAND(F.lit(1 << k)) != 0, MATRIX_FAULTS[k]).otherwise(reason)
    file = file.select("run_id", "path", reason.alias("fault"))
    genes = sums.where(F.col("idx").isNotNull()).select("run_id", "path", "idx", "count").join(names, ["run_id", "idx"]).groupBy("run_id", "path", "gene_id").agg(F.sum("count").alias("count"))
    joined = file.join(genes, ["run_id", "path"], "left")
    good = F.col("fault").isNull()
    return joined.select("run_id", "path", F.when(good, F.col("gene_id")).alias("gene_id"), F.when(good, F.col("count")).alias("count"), "fault").where(~good | F.col("gene_id").isNotNull()).distinct()


def multiqc(spark: SparkSession, path: str) -> DataFrame:
    """General statistics as long metrics; sections are a list or an object, a later section wins."""
    t = _text(spark, path, whole=True)
    part = "map<string,map<string,string>>"
    stats = F.try_variant_get(F.try_parse_json("value"), "$.report_general_stats_data", "variant")
    kind = F.schema_of_variant(stats)
    text = F.to_json(stats)
    sections = F.when(F.startswith(kind, F.lit("ARRAY")), F.from_json(text, f"array<{part}>")).otherwise(F.map_values(F.from_json(text, f"map<string,{part}>")))
    s = t.select("run_id", "path", F.posexplode(sections).alias("pos", "s")).select("run_id", "path", "pos", F.explode("s").alias("sample", "m")).select("run_id", "path", "pos", "sample", F.explode("m").alias("metric", "text"))
    return s.withColumn("value", S.number(F.col("text"))).where(F.col("value").isNotNull()).groupBy("run_id", "sample", "metric").agg(F.max_by("value", "pos").alias("value"))


# Names of columns in reports as tools write them, in lower case. Fixed values.
SAMPLE_NAMES = ["sample", "sample_id", "sampleid", "samples", "index"]
INPUT_NAMES = ["input", "input_reads", "reads_input", "dada2_input"]
NONCHIM_NAMES = ["nonchim", "non_chim", "non-chim", "nonchimeric", "non_chimeric", "non-chimeric", "dada2_nonchim"]
NO_SAMPLES = ["sequence", "sequences", "asv_id", "asv", "id", "otu", "otu_id", "taxonomy", "#otu id"]
BIN_NAMES = ["assembly", "bin", "bin id", "binid", "bin_id"]


def _has(names: list[str]) -> Column:
    return F.exists("cells", lambda z: F.lower(z["k"]).isin(*names))


def _aliased(names: list[str], or_first: bool = False) -> Column:
    """The cell of the first column of one of these names in any case, else of the first column if so wanted; blank and '-' are NULL."""
    hits = F.filter("cells", lambda z: F.lower(z["k"]).isin(*names))
    cell = F.get(hits, F.lit(0))["v"]
    if or_first:
        cell = F.when(F.size(hits) > 0, cell).otherwise(F.get("cells", F.lit(0))["v"])
    v = F.trim(cell)
    return F.when(~v.isin("", "-"), v)


def dada2(spark: SparkSession, path: str) -> DataFrame:
    """Reads in and kept by sample, and the percentage; NULL where no read came in. Files without either column say nothing."""
    t = _table(_text(spark, path)).where(_has(INPUT_NAMES) | _has(NONCHIM_NAMES))
    t = t.select("run_id", _aliased(SAMPLE_NAMES, or_first=True).alias("sample"), S.number(_aliased(INPUT_NAMES)).alias("input_reads"), S.number(_aliased(NONCHIM_NAMES)).alias("nonchim")).where("sample IS NOT NULL")
    return t.withColumn("percent_retained", F.when(F.col("input_reads") != 0, F.col("nonchim") / F.col("input_reads") * 100))


def asv_counts(spark: SparkSession, path: str) -> DataFrame:
    """Variants present in each sample; samples are the columns after the first that aren't named as ids, sequences or taxa and whose cells are all numbers."""
    cells = _table(_text(spark, path)).select("run_id", "path", F.posexplode("cells").alias("at", "c")).where((F.col("at") > 0) & ~F.lower("c.k").isin(*NO_SAMPLES) & (F.col("c.k") != ""))
    cells = cells.select("run_id", "path", F.col("at"), F.col("c.k").alias("sample"), S.number(F.col("c.v")).alias("n"))
    a = cells.groupBy("run_id", "path", "at", "sample").agg(F.bool_and(F.col("n").isNotNull()).alias("numeric"), F.count_if(F.col("n") != 0).alias("asv_count"))
    return a.where("numeric").select("run_id", "sample", "asv_count")


def quast(spark: SparkSession, path: str) -> DataFrame:
    """N50 of each bin, NULL where it is no number. Files without the column say nothing; without a column of bins the first one names them."""
    t = _table(_text(spark, path)).where(_has(["n50"]))
    return t.select("run_id", _aliased(BIN_NAMES, or_first=True).alias("bin"), S.number(_aliased(["n50"])).alias("n50")).where("bin IS NOT NULL")


def checkm(spark: SparkSession, path: str) -> DataFrame:
    """Completeness and contamination of each bin. Files without either column say nothing; without a column of bins the first one names them."""
    t = _table(_text(spark, path)).where(_has(["completeness"]) | _has(["contamination"]))
    return t.select("run_id", _aliased(BIN_NAMES, or_first=True).alias("bin"), S.number(_aliased(["completeness"])).alias("completeness"), S.number(_aliased(["contamination"])).alias("contamination")).where("bin IS NOT NULL")


def bismark(spark: SparkSession, path: str) -> DataFrame:
    """Percentages of the three report kinds by sample of the file name; a conversion rate only where a line says so."""
    t = _text(spark, path, whole=True)
    pick = lambda p: S.number(F.nullif(F.regexp_extract("value", "(?i)" + p, 1), F.lit("")))
    sample = F.regexp_replace("file_name", r"(_R?[12])?(_val_[12])?[._](bismark|trimmed|splitting|deduplication|dedup|PE|SE|conversion).*$", "")
    m = F.array(
        F.struct(F.lit("percent_aligned").alias("metric"), pick(r"mapping efficiency:[ \t]*([0-9.]+)[ \t]*%").alias("value")),
        F.struct(F.lit("percent_duplication").alias("metric"), pick(r"duplicated alignments removed:[ \t]*[0-9,]+[ \t]*\(([0-9.]+)%\)").alias("value")),
        F.struct(F.lit("percent_bs_conversion").alias("metric"), pick(r"conversion rate:[ \t]*([0-9.]+)[ \t]*%").alias("value")),
    )
    return t.select("run_id", sample.alias("sample"), F.explode(m).alias("m")).select("run_id", "sample", "m.*").where("value IS NOT NULL")


def rseqc(spark: SparkSession, path: str) -> DataFrame:
    """Exonic and intronic shares of assigned tags and the unassigned share; a file under results/ is preferred."""
    t = _text(spark, path)
    n = F.split(F.trim("value"), r"\s+")
    total = S.number(F.nullif(F.regexp_extract("value", r"^Total Tags\s+([0-9]+)", 1), F.lit("")))
    assigned = S.number(F.nullif(F.regexp_extract("value", r"^Total Assigned Tags\s+([0-9]+)", 1), F.lit("")))
    exon = F.when(n[0].isin("CDS_Exons", "5'UTR_Exons", "3'UTR_Exons"), S.number(F.get(n, F.lit(2))))
    intron = F.when(n[0] == "Introns", S.number(F.get(n, F.lit(2))))
    a = t.groupBy("run_id", "path", "file_name").agg(F.max(total).alias("total"), F.max(assigned).alias("assigned"), F.sum(exon).alias("exon"), F.max(intron).alias("intron"))
    a = a.withColumn("sample", F.regexp_replace("file_name", r"\.read_distribution\.txt$", ""))
    best = F.row_number().over(Window.partitionBy("run_id", "sample").orderBy(F.contains("path", F.lit("/results/")).cast("int").desc(), "path"))
    a = a.withColumn("b", best).where("b = 1")
    un = (F.col("total") - F.col("assigned")) / F.nullif(F.col("total"), F.lit(0.0))
    share = lambda c: F.col(c) / F.nullif(F.col("assigned"), F.lit(0.0))
    return a.select("run_id", "sample", share("exon").alias("exonic_fraction"), share("intron").alias("intronic_fraction"), F.when(un >= 0, un).alias("unassigned_fraction"))


def starsolo(spark: SparkSession, path: str) -> DataFrame:
    """field,value rows of each file as metrics."""
    c = F.split("value", ",")
    return _text(spark, path).select("run_id", "path", F.trim(c[0]).alias("metric"), S.number(F.get(c, F.lit(1))).alias("value")).where("value IS NOT NULL")


def _csv_cells(line: Column) -> Column:
    """The cells of a line of comma-separated values; quoted ones may hold commas and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(F.nullif(c, F.lit(""))))


def cellranger(spark: SparkSession, path: str) -> DataFrame:
    """The header row and value row of each file as metrics; thousands' commas go and percentages become fractions."""
    lines = F.filter(F.split("value", "\r\n|[\r\n]"), lambda x: F.trim(x) != "")
    rows = _text(spark, path, whole=True).select("path", lines.alias("l")).where(F.size("l") > 1)
    rows = rows.select("path", _csv_cells(F.col("l")[0]).alias("names"), F.explode(F.slice("l", F.lit(2), F.size("l") - 1)).alias("row"))
    cells = _csv_cells(F.col("row"))
    long = rows.select("path", F.explode(F.arrays_zip(F.col("names").alias("metric"), F.slice(cells, F.lit(1), F.size("names")).alias("t"))).alias("m")).select("path", "m.*")
    n = S.number(F.regexp_replace("t", "[,%]", ""))
    return long.select("path", "metric", F.when(F.endswith("t", F.lit("%")), n / 100).otherwise(n).alias("value"))


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The first source's rows, and the second's for samples that the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def kallisto(spark: SparkSession, path: str) -> DataFrame:
    t = _table(_text(spark, path))
    return t.select("run_id", _get("target_id").alias("transcript_id"), S.number(_get("est_counts")).alias("est_counts")).where("est_counts IS NOT NULL")


def t2g(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    return _text(spark, path).where(F.size(c) >= 2).select(c[0].alias("transcript_id"), c[1].alias("gene_id")).dropDuplicates(["transcript_id"])


def samplesheet(spark: SparkSession, path: str) -> DataFrame:
    """Rows with empty cells as NULL and strandedness auto by default; columns that a sheet lacks are NULL."""
    t = _table(_text(spark, path), ",")
    cols = [_get(c).alias(c) for c in ("patient", "sample", "status", "lane", "fastq_1", "fastq_2")]
    return t.select("run_id", F.col("path").alias("sheet_id"), *cols, F.coalesce(_get("strandedness"), F.lit("auto")).alias("strandedness"))


def sequence_names(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Sequence names of FASTA headers (first token) or of GTF column 1; comments are skipped."""
    t = _text(spark, path)
    if kind == "fasta":
        t = t.where(F.startswith("value", F.lit(">"))).select("run_id", F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("name"))
    else:
        t = t.where(~F.startswith("value", F.lit("#")) & F.contains("value", F.lit("\t"))).select("run_id", F.trim(F.substring_index("value", "\t", 1)).alias("name"))
    return t.where(F.col("name") != "").distinct()


def artifacts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Files under a folder with size, time and checksum; contents of any size are read on the executors and stay there."""
    return archives.digests(spark, path, suffix).select(_run(F.col("path")).alias("run_id"), "path", "size", "mtime", "sha256")


def logs(spark: SparkSession, path: str, errors: str | None = None, most: int = 10, tail: int = 40) -> DataFrame:
    """run.log of each run, and the ends of up to ``most`` error files."""
    t = _text(spark, path, whole=True).select("run_id", F.col("value").alias("log_text"))
    if errors is None:
        return t
    e = _text(spark, errors, whole=True).withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("path"))).where(F.col("n") <= most)
    lines = F.split("value", "\n")
    e = e.withColumn("end", F.array_join(F.slice(lines, F.greatest(F.size(lines) - tail + 1, F.lit(1)), tail), "\n"))
    ends = e.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "end"))), lambda x: x["end"]), "\n").alias("ends"))
    return t.join(ends, "run_id", "left").select("run_id", F.concat_ws("\n", "log_text", "ends").alias("log_text"))


def claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of JSON files, tolerance 0.1 by default; see operators.claims.claim_errors for what is wrong with them."""
    schema = "claims array<struct<id:string,value:double,tolerance:double,pointer:string,column:string,pattern:string,path:string>>"
    t = _text(spark, path, whole=True)
    c = t.select("run_id", F.explode(F.from_json("value", schema)["claims"]).alias("c"))
    return c.select("run_id", F.col("c.id").alias("claim_id"), F.col("c.value").alias("claimed"), F.coalesce("c.tolerance", F.lit(0.1)).alias("tolerance"), "c.pointer", "c.column", "c.pattern", "c.path")


def notifications(spark: SparkSession, path: str, limit: int = 30) -> DataFrame:
    """The newest events of known kinds."""
    df = jsonl(spark, path, "ts timestamp, run_id string, kind string, message string", ["ts", "kind"])
    return df.where(F.col("kind").isin("finished", "failed", "cancelled", "awaiting_approval")).orderBy(F.desc("ts"), "run_id").limit(limit)
