"""Steps whose cost must follow their input: what they give at sizes and shapes that small tables don't have."""

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S
from cohortlens.operators import annotations, claims
from cohortlens.plans import catalog, files
from cohortlens.sources import readers
from cohortlens.streaming import live, streams


def test_flat_results_are_read_once(spark, monkeypatch):
    """Ids that no path can hold are found, and an object too large for one variant gives the same entries."""
    n = 3000
    body = ", ".join(f'"c{k}": {k}' for k in range(n)) + ', "it\'s": 1.5, "t": "x", "z": null, "o": {"a": 1}'
    results = spark.createDataFrame([("a", "{" + body + "}"), ("b", '{"k": 1, "k": 2}'), ("c", "[1]"), ("d", '{"k": 1')], "run_id string, json string")
    ids = [("a", f"c{k}") for k in range(n)] + [("a", i) for i in ("it's", "t", "z", "o", "none")] + [(r, "k") for r in "bcde"]
    wanted = spark.createDataFrame(ids, "run_id string, claim_id string")
    want = {("a", f"c{k}"): (float(k), "ok") for k in range(n)} | {("a", "it's"): (1.5, "ok"), ("a", "none"): (None, "missing")}
    want |= {("a", i): (None, "not a number") for i in "tzo"} | {(r, "k"): (None, "missing") for r in "bcde"}
    for limit in (claims.MAX_TEXT, 0):
        monkeypatch.setattr(claims, "MAX_TEXT", limit)
        got = {(r.run_id, r.claim_id): (r.observed, r.reason) for r in claims.observe_flat(wanted, results).collect()}
        assert got == want, {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}


def test_small_files_as_rows_read_as_files(spark, tmp_path):
    """A table of small files gives what its files give, line ends and the lack of one included."""
    texts = {
        "a": "Total Tags   200\r\nTotal Assigned Tags  100\nGroup Total_bases\n\nCDS_Exons  900 50 1.0\rIntrons 99 20 0.1",
        "b": "Assembly\tN50\tCompleteness\nb1\t5000\t-\n\nb2\tx\t98.5\n",
        "c": '{"claims": [{"id": "c", "value": 1}]}\n',
        "d": "estimated_cells,12\nMapping efficiency:\t78.9%\nbad,x\n",
        "e": "",
    }
    loose = tmp_path / "runs"
    for run_id, text in texts.items():
        (loose / run_id).mkdir(parents=True)
        (loose / run_id / "S1_bismark_report.txt").write_bytes(text.encode())
    at = str(tmp_path / "files.parquet")
    spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(loose)).write.parquet(at)
    rows = lambda df: sorted(map(repr, df.collect()))
    for reader in (readers.rseqc, readers.starsolo, readers.bismark, readers.claims, readers.quast, readers.checkm, readers.cellranger):
        got, want = rows(reader(spark, at)), rows(reader(spark, str(loose)))
        assert got == want and got, reader.__name__
    plain = lambda source: rows(readers._text(spark, source).select("run_id", "path", "file_name", "value"))
    assert plain(at) == plain(str(loose))
    kept = ["run_id", "size", "sha256"]
    assert rows(readers.artifacts(spark, at, ".txt,.md").select(kept)) == rows(readers.artifacts(spark, str(loose)).where("size > 0").select(kept))  # binaryFile leaves empty ones out
    assert readers.artifacts(spark, at, ".md").count() == 0


def test_metric_summaries_have_headers_of_their_own(spark, tmp_path):
    for run_id, text in (("a", '"cells","reads, mean"\n"1,234","25%"\n'), ("b", "reads,other,last\n7,,say\r\n\r\n")):
        (tmp_path / "runs" / run_id).mkdir(parents=True)
        (tmp_path / "runs" / run_id / "metrics_summary.csv").write_text(text)
    got = {(r.path.split("/")[-2], r.metric): r.value for r in readers.cellranger(spark, str(tmp_path / "runs")).collect()}
    assert got == {("a", "cells"): 1234.0, ("a", "reads, mean"): 0.25, ("b", "reads"): 7.0, ("b", "other"): None, ("b", "last"): None}


def test_reports_of_many_runs_take_few_files(spark, tmp_path):
    lines = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("run_id"), F.explode(F.sequence(F.lit(3), F.lit(1))).alias("n")).withColumn("value", F.concat("run_id", F.lit("-"), "n"))
    at = files.pack(lines)
    assert spark.read.parquet(at).inputFiles() and len(spark.read.parquet(at).inputFiles()) <= 8
    t = readers._text(spark, at)
    assert t.count() == 6000 and t.where("value <> concat(run_id, '-', line.id + 1)").count() == 0


class Handle:
    """State of one run in plain variables, with the timers that were set."""

    def __init__(self):
        self.timers, self.value, self.map = [], None, {}

    def getMapState(self, *_):  # noqa: N802
        return SimpleNamespace(getValue=self.map.get, updateValue=self.map.__setitem__, removeKey=self.map.pop)

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_waiting_heartbeats_share_timers():
    """20,000 heartbeats of two hours, in two batches: a timer for each slot, and the results of a walk over them in order."""
    rnd, held = random.Random(5), Handle()
    beats = sorted((rnd.randrange(0, 7_200_000_000), rnd.randrange(3), 1, 1) for _ in range(20_000))
    stall = live.Stall(2.0, 10**12, 600_000)
    stall.init(held)
    for part in (beats[::2], beats[1::2]):
        list(stall.handleInputRows(("a",), iter([pd.DataFrame(rnd.sample(part, len(part)), columns=["us", *streams.FIELDS])]), None))
    assert len(held.timers) == 12
    out = pd.concat([f for t in sorted(held.timers) for f in stall.handleExpiredTimer(("a",), None, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))])
    want, since, old = [], 0, None
    for us, *fields in beats:
        since, old = (us, fields) if fields != old else (since, old)
        want.append(((us - since) / 1e6, (us - since) / 1e6 >= 2.0))
    assert list(zip(out["idle_sec"], out["stalled"], strict=True)) == want and any(s for _, s in want)
    assert not held.map and held.timers[12:] == [held.value[-1]]


def test_call_sets_lie_in_several_files_by_site(spark, monkeypatch):
    """A run's calls are cut by site into files that grow in number with the rows; each has the header, and rows of a site keep their order."""
    monkeypatch.setattr(files, "FILE_ROWS", 50)
    calls = spark.range(2000).selectExpr("'r1' run_id", "'1' chrom", "id % 700 pos", "'A' ref", "'C' alt", "if(id >= 1400, '1/1', '0/0') gt", "'PASS' filter", "id o1", "0 o2", "0 o3")
    at = files._vcf(calls)
    assert files.n_files(calls) == 40 and files.n_files(calls.limit(10)) == files.FILES
    heads = readers.vcf_header(spark, at)
    assert heads.count() == 40 and heads.where("size(gatk) = 1 and build = 'GRCh37'").count() == 40
    read = readers.vcf(spark, at)
    sites = read.groupBy("run_id", "pos").agg(F.max_by("gt", "line").alias("gt"), F.count("*").alias("n"), F.count_distinct("path").alias("paths"))
    assert read.count() == 2000 and sites.where("paths <> 1").count() == 0 and sites.where("n = 3 and gt = '1/1'").count() == 600


def test_matrices_are_read_before_they_are_compared(spark):
    plan = catalog.QUERIES["q_op_sc_count_concordance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "BatchScan" not in plan


def test_annotators_meet_in_one_shuffle(spark):
    """Terms and symbols of both sides take one grouping of the sites, with the last row that counts on either side."""
    rows = lambda *r: spark.createDataFrame([("r", "1", p, "A", "C", line, ann, 1, 2) for p, line, ann in r], "run_id string, chrom string, pos int, ref string, alt string, line int, ann string, idx int, sym_idx int")
    a = rows((1, 1, "A|stop_gained&intron_variant|X"), (1, 2, ""), (2, 1, "A|intron_variant|K"), (2, 2, "A|stop_gained|"), (3, 1, ""))
    b = rows((1, 1, "A|Stop_Gained|x"), (2, 1, "A|stop_gained|k"), (3, 1, "A|stop_gained|k"), (4, 1, "A|intron_variant|z"))
    terms, symbols = (f(a, b).drop("agreement") for f in (annotations.consequence_concordance, annotations.symbol_concordance))
    assert tuple(terms.first())[:3] == ("r", 2, 2) and symbols.count() == 0
    assert annotations.consequence_concordance(a.where("ann = ''"), b.where("ann = ''")).count() == 0
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")
    assert plan(terms) == plan(symbols) == 2
    assert [r.t for r in spark.createDataFrame([(["u", "stop_gained", "intron_variant"],), ([],), (None,)], "v array<string>").select(S.most_severe(F.col("v")).alias("t")).collect()] == ["stop_gained", None, None]
