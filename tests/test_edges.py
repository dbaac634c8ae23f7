"""Hand-made edge rows: bands, genotypes, claims, archives and live runs."""

import gzip
import os
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S
from cohortlens.functions import tables
from cohortlens.operators import corpus, counts, qc, references, runs, text, variants
from cohortlens.plans import catalog, views
from cohortlens.sources import readers
from cohortlens.streaming import streams

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("gt", "want"), [("0/1", "0/1"), ("1|0", "0/1"), ("./.", None), (".", None), ("", None), ("./1", "./1"), ("10/2", "10/2"), (" 1/1 ", "1/1"), (None, None)])
def test_genotypes(spark, gt, want):
    assert one(spark, S.normalize_gt(F.lit(gt).cast("string"))) == want


@pytest.mark.parametrize(("value", "want"), [(1.2, "warn"), (1.19, "fail"), (1.8, "pass"), (2.4, "pass"), (2.41, "warn"), (3.6, "warn"), (3.61, "fail"), (None, "unverified"), (float("nan"), "unverified")])
def test_bands(spark, value, want):
    assert one(spark, S.band_status(F.lit(value).cast("double"), *[F.lit(x) for x in (1.2, 1.8, 2.4, 3.6)])) == want


@pytest.mark.parametrize(("claimed", "observed", "want"), [(1.0, 1.0, "reproduced"), (1.0, 1.1, "within_tolerance"), (1.0, 1.2, "diverged"), (0.0, 0.05, "within_tolerance"), (1.0, None, "unverified"), (1.0, float("inf"), "unverified"), (1.0, float("nan"), "unverified")])
def test_claims(spark, claimed, observed, want):
    assert one(spark, S.claim_status(F.lit(claimed), F.lit(observed).cast("double"), F.lit(0.1000001))) == want


@pytest.mark.parametrize(("t", "want"), [("1m 2s", 62.0), ("250ms", 0.25), ("1h", 3600.0), ("-", 0.0), (None, 0.0), ("2d 3h", 183600.0)])
def test_durations(spark, t, want):
    assert one(spark, S.duration_sec(F.lit(t).cast("string"))) == pytest.approx(want)


def test_numbers_are_strict(spark):
    assert [one(spark, S.number(F.lit(x))) for x in ("1d", "1_0", "1e3", ".5", "x", "")] == [None, None, 1000.0, 0.5, None, None]


def test_last_line_wins_and_self_concordance(spark):
    rows = [("r", "1", 1, "A", "G", "0/0", 1), ("r", "1", 1, "A", "G", "0/1", 2), ("r", "X", 2, "C", "T", "./.", 3)]
    calls = spark.createDataFrame(rows, "run_id string, chrom string, pos long, ref string, alt string, gt string, line int")
    r = variants.genotype_concordance(calls, calls).first()
    assert (r.shared, r.comparable, r.concordant, r.rate, r.overlap) == (2, 1, 1, 1.0, 1.0)
    empty = variants.genotype_concordance(calls.limit(0), calls).first()
    assert (empty.shared, empty.rate, empty.overlap_status, empty.rate_status) == (0, None, "warn", "unverified")


def test_constant_counts_have_no_correlation(spark):
    df = spark.createDataFrame([("r", str(i), 5.0) for i in range(12)], "run_id string, gene_id string, count double")
    r = counts.count_concordance(df, df).first()
    assert (r.rho, r.rho_status, r.agree_status, r.overlap) == (None, "unverified", "pass", 1.0)


def test_skew_and_outliers(spark):
    m = spark.createDataFrame([("a", "x", "n", 0.0), ("a", "y", "n", 3.0), ("b", "x", "n", 0.0), ("b", "y", "n", 0.0), ("c", "x", "n", 1.0), ("c", "y", "n", 10.0), ("d", "x", "n", 1.0)], "run_id string, sample string, metric string, value double")
    assert {r.run_id: r.status for r in qc.library_skew(m, "n").collect()} == {"a": "fail", "b": "unverified", "c": "fail"}
    same = spark.createDataFrame([("a", s, "n", 1.0) for s in "wxyz"], "run_id string, sample string, metric string, value double")
    assert qc.mad_outliers(same, "n").count() == 0
    assert qc.min_samples(spark.createDataFrame([("a", "S Read 1"), ("a", "S Read 2")], "run_id string, sample string")).first().status == "fail"


def test_verdicts(spark):
    checks = spark.createDataFrame([("a", "pass", False), ("a", "fail", True), ("b", "unverified", False)], "run_id string, status string, informational boolean")
    assert {r.run_id: r.verdict for r in qc.verdict(checks).collect()} == {"a": "pass", "b": "unverified"}
    tasks = spark.createDataFrame([("c", "FAILED", None), ("a", "COMPLETED", None)], "run_id string, status string, exit_code int")
    of = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id string")
    assert {r.run_id: r.verdict for r in qc.run_verdict(of, checks, tasks).collect()} == {"a": "pass", "b": "unverified", "c": "fail", "d": "unverified"}


def test_a_changed_band_flips_the_verdict(spark):
    m = spark.createDataFrame([("a", "s", "ts_tv", 2.0)], "run_id string, sample string, metric string, value double")
    pack = qc.rules(spark, "variant_calling")
    assert qc.verdict(qc.rule_eval(m, pack)).first().verdict == "pass"
    assert qc.verdict(qc.rule_eval(m, pack.withColumn("fail_above", F.lit(1.9)))).first().verdict == "fail"


@pytest.mark.parametrize(("log", "want"), [("", "unknown"), (None, "unknown"), ("java.lang.OutOfMemoryError\nno space left on device", "oom"), ("a.bai\nnot found", "unknown"), ("a.bai not found", "missing_index"), ("cram_decode_slice", "unknown"), ("conda could not\nsolve", "conda_solve_failed")])
def test_diagnosis(spark, log, want):
    df = spark.createDataFrame([("r", log)], "run_id string, log_text string")
    assert text.diagnose(df).first().failure_class == want


def test_claims_in_text(spark):
    df = spark.createDataFrame([(1, "AUC of 0.9 and AUC of 0.9. AUC was 0.8."), (2, "recall < 0.5"), (3, None), (4, "accuracy 12 items")], "doc_id int, text string")
    assert sorted((r.doc_id, r.claim_id, r.value) for r in text.extract_claims(df).collect()) == [(1, "auc", 0.9), (1, "auc_2", 0.8)]


def test_harmonize_refuses_merging_names(spark):
    f = spark.createDataFrame([("r", "chr1")], "run_id string, name string")
    g = spark.createDataFrame([("r", "1"), ("r", "chr1")], "run_id string, name string")
    none = spark.createDataFrame([], "name string, grp string")
    assert references.harmonize_plan(f, g, none).count() == 0
    assert references.harmonize_plan(f, g.where("name = '1'"), none).first().new_name == "chr1"


def test_archives(spark):
    good = gzip.compress(b"x" * 100000)
    bad = good[:-20] + bytes(20)
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(good[:-9])), ("c", bytearray(b"no")), ("d", bytearray(bad)), ("e", bytearray(good + good)), ("f", None)], "path string, content binary")
    got = {r.path: r.status for r in runs.archive_integrity(df).collect()}
    assert got["a"] == got["e"] == "pass" and got["b"] == "truncated" and got["c"] == got["f"] == "no gzip" and got["d"] in ("corrupt", "truncated")


def test_promotion_errors(spark):
    s = "case_id string, label string, source string"
    p, g = spark.createDataFrame([("1", None, "pending:x")], s), spark.createDataFrame([("2", "a", "user:x")], s)
    d = spark.createDataFrame([("1", "b"), ("2", "b"), ("3", "b")], "case_id string, label string")
    rest, gold, errors = corpus.promote(p, g, d)
    assert rest.count() == 0 and {(r.case_id, r.label, r.source) for r in gold.collect()} == {("1", "b", "confirmed:x"), ("2", "a", "user:x")}
    assert {(r.case_id, r.reason) for r in errors.collect()} == {("2", "already golden"), ("3", "unknown case")}


def test_wide_files_are_read_to_their_last_column(spark, tmp_path):
    (tmp_path / "v/runs/r").mkdir(parents=True)
    (tmp_path / "m/runs/r").mkdir(parents=True)
    names = [f"s{i}" for i in range(1500)]
    fixed = ["1", "7", ".", "A", "G", "50", "PASS", ".", "GT"]
    head = ["##tumor_sample=s1499", "##normal_sample=s1200", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    rows = ["\t".join([*fixed, *[f"0/{i}" for i in range(1500)]]), "\t".join(fixed[:5])]
    (tmp_path / "v/runs/r/a.vcf").write_text("\n".join([*head, *rows]) + "\n")
    samples = sorted((r.samples or [] for r in readers.vcf(spark, str(tmp_path / "v")).collect()), key=len)
    assert [len(x) for x in samples] == [0, 1500] and samples[1][-1] == "0/1499"
    h = readers.vcf_header(spark, str(tmp_path / "v")).first()
    assert (h.tumor_at, h.normal_at) == (1499, 1200)
    (tmp_path / "m/runs/r/a.tsv").write_text("g\t" + "\t".join(["1"] * 100_500) + "\nh\n")
    assert [(r.gene_id, r["count"]) for r in readers.count_matrix(spark, str(tmp_path / "m")).collect()] == [("g", 100_500.0)]


def test_capture_appends_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "fail"), ("a", "fail"), ("b", "pass")], "run_id string, verdict string")
    df.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = streams.capture(stream, str(tmp_path / "out"), str(tmp_path / f"cp{k}")).start()
        q.processAllAvailable()
        q.stop()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "fail")]


def claims_by_hand(text):
    """(slug, value, unit) in order of appearance, by walking over the words of the text."""
    low, out, at = (text or "").lower(), [], 0
    words = sorted(tables.METRIC_WORDS, key=lambda w: (-len(w), w))
    alone = lambda i, j: not (low[i - 1 : i].isascii() and low[i - 1 : i].isalnum()) and not (low[j : j + 1].isascii() and low[j : j + 1].isalnum())
    holds = lambda s: any(w in s and any(not re.match("[a-z0-9]", s[i - 1 : i] or " ") and not re.match("[a-z0-9]", s[i + len(w) : i + len(w) + 1] or " ") for i in range(len(s)) if s.startswith(w, i)) for w in words)
    while at < len(low):
        w = next((w for w in words if low.startswith(w, at) and alone(at, at + len(w))), None)
        if w is None:
            at += 1
            continue
        rest = low[at + len(w) :]
        m = re.match(r"([^0-9]{0,40}?)([-+]?[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?)(\s*%)?", rest)
        at += len(w)
        if not m:
            continue
        gap = m[1]
        linked = any(re.search(rf"\b{c}\b", gap) if c.isalpha() else c in gap for c in tables.CONNECTIVES)
        if linked and not holds(gap) and not any(gap.strip(" ").endswith(x) for x in tables.INEQUALITIES):
            slug = re.sub("[^a-z0-9]+", "_", w.replace("²", "2"))
            if (slug, float(m[2])) not in [x[:2] for x in out]:
                out.append((slug, float(m[2]), "percent" if (m[3] or "").strip() == "%" else None))
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", ["q_op_extract_claims", "q_w_claim_merge"])
def test_claims_of_whole_texts(spark, name):
    """No twin can say these in SQL, so they are held against a walk over the same texts."""
    texts = [(r.doc_id, r.text) for r in views.spark_view(spark, SF, "claim_texts").collect()]
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, SF).collect())
    found = [(i, c) for i, t in texts for c in claims_by_hand(t)]
    assert len(found) > 100
    if name == "q_w_claim_merge":
        assert got == sorted((i, s, v, "extra" if unit else "core") for i, (s, v, unit) in found)
    else:
        assert sorted(((r[0], r[2], r[3], r[4]) for r in got), key=repr) == sorted(((i, s, v, unit) for i, (s, v, unit) in found), key=repr)


def test_claims_of_odd_texts(spark):
    odd = ["AUC of 0.9, auc was 0.8 and AUC = 0.9", "recall <= 0.5 of 3", "accuracy of precision was 7 %", "f1 scorex is 3", "f1 score: -1e-3%", "xauc is 1", "R² = .5 and r² is 0.5", "a" * 5000 + " dice at 2", "", None, "log2 fold change of " + "x" * 38 + " 4", "iou reached 1.5.2"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.metric, r.value, r.unit) for r in text.extract_claims(df).collect()), key=repr)
    assert got == sorted(((i, *c) for i, t in enumerate(odd) for c in claims_by_hand(t)), key=repr) and len(got) > 6


def test_single_cell_matrices_are_routed_by_name(spark, tmp_path):
    feats = tmp_path / "f" / "runs"
    data = tmp_path / "d" / "runs"
    for run in ("a", "b", "c"):
        (feats / run).mkdir(parents=True)
        (data / run).mkdir(parents=True)
        (feats / run / "features.tsv").write_text("g1\tx\ng2\ty\n")
    (data / "a" / "m.mtx").write_text("%%MatrixMarket\n2 3 3\n1 1 4\n1 3 5\n2 2 1\n")
    with gzip.open(data / "b" / "m.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket\n% note\n3 2 1\n3 2 7\n")
    (data / "c" / "m.tsv").write_text("gene\tc1\tc2\ng1\t1\t2\ng1\t\t4\ng2\tx\ty\n")
    got = readers.sc_matrix(spark, str(data), str(feats)).collect()
    assert sorted((r.run_id, r.gene_id, r["count"]) for r in got) == [("a", "g1", 9.0), ("a", "g2", 1.0), ("b", "g2", 7.0), ("c", "g1", 7.0)]


@pytest.mark.parametrize(("bounds", "want"), [((1.0, 2.0, 3.0, None), "[2.00, 3.00]"), ((1.0, None, None, None), ">= 1.00"), ((None, None, None, 9.5), "<= 9.50"), ((None,) * 4, None)])
def test_expected_ranges(spark, bounds, want):
    assert one(spark, S.expected_range(*[F.lit(b).cast("double") for b in bounds])) == want


def test_matrices_end_as_rows_or_with_a_fault(spark, tmp_path):
    """Nothing vanishes: each file gives genes or one fault, the lowest of several."""
    feats, data = tmp_path / "f" / "runs", tmp_path / "d e" / "runs"
    files = {
        "empty": "", "comment": "%%MatrixMarket\n%x\n", "square": "%%MatrixMarket\n2 2 1\n1 1 4\n", "far": "2 3 1\n3 1 4\n1 1 1\n", "cell": "2 3 1\n1 4 4\n", "zero": "2 3 1\n0 1 4\n", "half": "2 3 1\n1.5 1 4\n", "text": "2 3 1\n1 1 x\n1 1 2\n",
        "short": "2 3 1\n1 1\n", "nodims": "a b c\n1 1 1\n", "other": "5 3 1\n1 1 1\n", "good": "2 3 2\n1 1 4\n1 3 5\n", "turned": "3 2 1\n3 2 7\n", "nothing": "2 3 0\n", "both": "2 2 1\n9 9 x\n",
    }
    for name, content in files.items():
        (data / name).mkdir(parents=True)
        (data / name / "m.mtx").write_text(content)
        (feats / name).mkdir(parents=True)
        (feats / name / "features.tsv").write_text("g1\tx\ng2\ty\n")
    (data / "nofeatures").mkdir()
    (data / "nofeatures" / "m.mtx").write_text("2 3 1\n1 1 4\n")
    for name, content in {"dense": "gene\tc1\ng1\t3\n", "nodense": "gene\tc1\n", "emptydense": ""}.items():
        (data / name).mkdir()
        (data / name / "m.tsv").write_text(content)
    found = readers.matrices(spark, str(data), str(feats))
    got = {}
    for r in found.collect():
        got.setdefault(r.run_id, []).append(r.fault or (r.gene_id, r["count"]))
    f = readers.MATRIX_FAULTS
    assert {k: sorted(v) for k, v in got.items()} == {
        "empty": [f[0]], "comment": [f[0]], "square": [f[2]], "far": [f[5]], "cell": [f[5]], "zero": [f[5]], "half": [f[5]], "text": [f[6]], "short": [f[6]], "nodims": [f[1]], "other": [f[4]], "good": [("g1", 9.0)], "turned": [("g2", 7.0)],
        "both": [f[2]], "nofeatures": [f[3]], "dense": [("g1", 3.0)], "nodense": [f[0]], "emptydense": [f[0]],
    }
    assert {r.run_id: r.reason for r in readers.matrix_errors(found).collect()}["square"] == f[2]


def test_patterns_with_and_without_groups(spark):
    from cohortlens.operators import claims

    rows = [("a", "x 12 y", "[0-9]+", 12.0), ("b", "x 12 y", "x ([0-9]+)", 12.0), ("c", "(7)", r"\(7\)", None), ("d", "7.5", r"[(0-9.]+", 7.5), ("e", "n=3", "(?<v>[0-9])", 3.0), ("f", "n=3", "(?:n=)?[0-9]", None), ("g", "3 3", "[0-9]", None), ("h", "v 8", r"(?<=v )8", 8.0), ("i", "", "[0-9]", None), ("j", r"\4", r"\\(4)", 4.0)]
    df = spark.createDataFrame([("r", k, k, t, p) for k, t, p, _ in rows], "run_id string, claim_id string, path string, text string, pattern string")
    got = {r.claim_id: r.observed for r in claims.observe_pattern(df.select("run_id", "claim_id", "path", "pattern"), df.select("run_id", "path", "text")).collect()}
    assert got == {k: v for k, _, _, v in rows}


def test_notebook_shapes(spark):
    import json

    from cohortlens.operators import claims

    cells = [
        {"source": ["one\n", "two"], "outputs": [{"output_type": "stream", "name": "stdout", "text": "a 1"}, {"output_type": "stream", "name": "stderr", "text": "a 9"}]}, {"source": "one", "outputs": [{"output_type": "stream", "name": "stdout", "text": ["a ", 5, "2"]}]},
        {"source": None, "outputs": [{"output_type": "display_data", "data": {"text/plain": "a 3"}}, {"output_type": "execute_result", "data": {"text/plain": ["\na", " x"]}}, {"output_type": "error", "text": "a 7"}, 4]}, {"source": "none", "outputs": []}, "no cell", {"source": "html", "outputs": [{"output_type": "display_data", "data": {"text/html": "a 1"}}]},
    ]
    books = spark.createDataFrame([("r", "n", json.dumps({"cells": cells})), ("r", "bad", "{"), ("r", "list", "[1]")], "run_id string, path string, text string")
    c = [(str(i), "n", i, None) for i in range(7)] + [("two", "n", None, "two"), ("one", "n", None, "one"), ("not", "n", None, "zzz"), ("bad", "bad", 0, None), ("list", "list", None, "a"), ("file", "gone", 0, None)]
    df = spark.createDataFrame([("r", *x, "a ([0-9])") for x in c], "run_id string, claim_id string, path string, cell int, contains string, pattern string")
    got = {r.claim_id: (r.observed, r.reason) for r in claims.observe_notebook(df, books).collect()}
    no = lambda why: (None, why)
    assert got == {"0": (1.0, "ok"), "1": (2.0, "ok"), "2": (3.0, "ok"), "3": no("no output"), "4": no("no output"), "5": no("no match"), "6": no("no cell"), "two": (1.0, "ok"), "one": no("several cells"), "not": no("no cell"), "bad": no("no cell"), "list": no("no cell"), "file": no("no cell")}


def test_cells_by_place_across_blocks(spark, tmp_path):
    """Rows keep their places where a file is read in several blocks."""
    from cohortlens.operators import claims

    (tmp_path / "runs" / "r").mkdir(parents=True)
    (tmp_path / "runs" / "r" / "t.tsv").write_text("id\tv\n" + "".join(f"i{i}\t{i * 2}\n" for i in range(3000)) + "short\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = readers._text(spark, str(tmp_path / "runs"))
        assert lines.select("line.file_block_start").distinct().count() > 5
        path = lines.first().path
        c = [("a", "v", None, 0, None, None), ("b", None, 1, 2999, None, None), ("c", "v", None, 3001, None, None), ("d", "v", None, 3000, None, None), ("e", "v", None, None, "id", " i77 "), ("f", "v", None, None, "id", "zz"), ("g", "v", None, None, "no", "i7"), ("h", None, 2, 0, None, None), ("i", None, -1, 0, None, None)]
        df = spark.createDataFrame([("r", k, path, True, *x) for k, *x in c] + [("r", "j", path, False, None, 0, 0, None, None), ("r", "k", path, False, "v", None, 0, None, None), ("r", "l", "gone", True, "v", None, 0, None, None)], "run_id string, claim_id string, path string, header boolean, column string, column_at int, row_at long, key_column string, key string")
        got = {r.claim_id: (r.observed, r.reason) for r in claims.observe_cell(df, lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    no = lambda why: (None, why)
    assert got == {"a": (0.0, "ok"), "b": (5998.0, "ok"), "c": no("no row"), "d": no("short row"), "e": (154.0, "ok"), "f": no("no row"), "g": no("no key column"), "h": no("no column"), "i": no("no column"), "j": no("not a number"), "k": no("name without a header"), "l": no("no rows")}


def test_masks_of_ranges(spark):
    rows = [("chr1", 1), ("1", 10), ("1", 11), ("1", 70_000), ("1", 200_000), ("2", 10), ("X", 5), ("X", -1)]
    calls = spark.createDataFrame([("r", c, p) for c, p in rows], "run_id string, chrom string, pos long")
    ranges = [("1", 5, 10), ("1", 8, 9), ("chr1", 60_000, 150_000), ("x", -3, 2), ("2", 20, 5), ("2", None, 50), ("3", 1, 9)]
    for size in (7, 1000, 1 << 20):
        got = variants.range_mask(calls, spark.createDataFrame(ranges, "chrom string, lo long, hi long"), size).collect()
        assert sorted((r.chrom, r.pos) for r in got) == [("1", 11), ("1", 200_000), ("2", 10), ("X", 5), ("chr1", 1)]
    assert variants.range_mask(calls, spark.createDataFrame([], "chrom string, lo long, hi long")).count() == len(rows)


def test_crates_are_arrays_in_a_fixed_order(spark):
    import json

    r = spark.createDataFrame([("a", "p/x", "v1", "pass", {"k": "1", "b": "2"}), ("b", None, None, None, None)], "run_id string, pipeline string, pipeline_revision string, verdict string, parameters map<string,string>")
    f = spark.createDataFrame([("a", "out/z", "s1", None), ("a", "out/y", "s2", "output"), ("a", "in/q", "s3", "input"), ("a", "in/q", "s3", "input")], "run_id string, path string, sha256 string, role string")
    q = spark.createDataFrame([("a", "c2", "warn", None), ("a", "c1", "pass", 2.0)], "run_id string, check string, status string, value double")
    got = {x.run_id: json.loads(x.document) for x in runs.rocrate(r, f, q).collect()}
    assert [e["@id"] for e in got["a"]["@graph"]] == ["ro-crate-metadata.json", "./", "p/x", "in/q", "out/y", "out/z"]
    root = got["a"]["@graph"][1]
    assert root["hasPart"] == [{"@id": "in/q"}, {"@id": "out/y"}, {"@id": "out/z"}] and root["parameters"] == {"b": "2", "k": "1"} and list(root["parameters"]) == ["b", "k"] and [c["check"] for c in root["qcResults"]] == ["c1", "c2"]
    assert got["a"]["@graph"][2] == {"@id": "p/x", "@type": "SoftwareApplication", "name": "p/x", "version": "v1"} and got["a"]["@context"].endswith("/context")
    assert [e["@id"] for e in got["b"]["@graph"]] == ["ro-crate-metadata.json", "./"]


def test_a_kill_by_137_is_its_own_evidence(spark):
    logs = spark.createDataFrame([("a", "nothing"), ("b", "Killed"), ("c", "out of memory")], "run_id string, log_text string")
    events = spark.createDataFrame([("a", "FAILED", 137), ("b", "FAILED", 137), ("c", "FAILED", 1)], "run_id string, status string, exit_code int")
    got = {r.run_id: (r.failure_class, list(r.evidence)) for r in text.diagnose(logs, events).collect()}
    assert got == {"a": ("oom", ["exit 137"]), "b": ("oom", ["exit 137", "Killed"]), "c": ("oom", ["out of memory"])}
