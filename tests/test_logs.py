"""Logs are searched where they are read: what moves, and the results against a walk over the lines."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import lines as L
from cohortlens.functions import scalars as S
from cohortlens.functions.tables import FAILURES, SALIENT
from cohortlens.operators import corpus, text
from cohortlens.plans import catalog

SF = "/root/testdata/sf0.001"
WORDS = ["Killed", "out of memory", "NOT FOUND", "index", ".bai", ".dict", "older than", "conda", "solve", "requested image's platform", "for CRAM decoding", ".cram", "Error", "plain", "über", "/a/b.c-d", "/", "2024-01-02 03:04:05.6Z", "deadbeef", "éfacade", "7", "", " ", "no such file or directory", "genome", "unknown option", "cannot index files compressed with gzip", "resolvepackagenotfound", "Terminating the stalled run", "CANCELLED DUE TO TIME LIMIT", "No space left on device", "Permission denied", "failed to pull", "connection timed out"]


def joined(node):
    """Columns of both sides of each join."""
    kids = [node.children().apply(i) for i in range(node.children().size())]
    if node.nodeName() == "Join":
        yield {k.output().apply(i).name() for k in kids for i in range(k.output().size())}
    for k in kids:
        yield from joined(k)


@pytest.mark.parametrize("name", ["q_op_clusters", "q_op_diagnose"])
def test_no_text_meets_the_events(spark, name):
    moved = list(joined(catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()))
    assert len(moved) == 1 and "run_id" in moved[0] and not moved[0] & {"log_text", "__lines", "__hits"}


def walked(log, oom, failed, noexit):
    lines, low = re.split("\r?\n", log or ""), (log or "").lower()
    for cls, conf, groups in FAILURES:
        hit = [x for x in lines if all(any(n in x.lower() for n in g) for g in groups)]
        fires = bool(hit) or (cls == "oom" and oom) or (cls == "conda_solve_failed" and "conda" in low and "solve" in low)
        fires = fires and (cls != "platform_unsupported" or noexit) and (cls != "alignment_format_mismatch" or ".cram" in low)
        if fires:
            return cls, conf, (["exit 137"] if cls == "oom" and oom else []) + hit
    return ("tool_crash", 0.4, [x for x in lines if x.strip(" ")][-1:]) if failed else ("unknown", 0.2, [])


def digest(log):
    if log is None:
        return None
    lines = []
    for x in log.lower().split("\n"):
        for what, mark in L.MARKS:
            x = re.sub(what, mark, x, flags=re.ASCII)
        lines.append(x.strip(" "))
    some = [x for x in lines if re.search("|".join(SALIENT), x)]
    return hashlib.sha256("\n".join(some or [x for x in lines if x]).encode()).hexdigest()[:16]


def test_logs_equal_a_walk_over_their_lines(spark, monkeypatch):
    """Random logs in several pieces of a batch, with line ends of both kinds, empty and missing ones and all kinds of events."""
    monkeypatch.setattr(L, "PIECE", 2000)
    rnd = random.Random(3)
    logs = [None, "", "\n", "\r\n \n"] + ["".join(rnd.choice(WORDS) + rnd.choice([" ", " ", "\n", "\r\n", "x"]) for _ in range(rnd.randrange(9))) for _ in range(1500)]
    ends = [rnd.choice([("COMPLETED", 0), ("FAILED", 137), ("FAILED", 1), ("FAILED", None), None]) for _ in logs]
    rows = spark.createDataFrame([(str(i), x) for i, x in enumerate(logs)], "run_id string, log_text string").coalesce(2)
    events = spark.createDataFrame([(str(i), *e) for i, e in enumerate(ends) if e], "run_id string, status string, exit_code int")
    cases = text.diagnose(rows, events, beside={"signature": S.signature(F.col("log_text"))})
    got = {int(r.run_id): ((r.failure_class, r.confidence, list(r.evidence)), r.signature) for r in cases.collect()}
    want = {i: (walked(x, e == ("FAILED", 137), bool(e) and e[0] == "FAILED", e == ("FAILED", None)), digest(x)) for i, (x, e) in enumerate(zip(logs, ends, strict=True))}
    assert got == want and len({d[0] for d, _ in want.values()}) > 10
    found = corpus.clusters(cases.withColumnRenamed("run_id", "case_id")).collect()
    assert sum(r.n for r in found) == len(logs) and len(found) == len({(d[0], s) for d, s in want.values()})


def test_a_long_path_is_one_path(spark):
    """A path of many folders, on which a backtracking pattern overflows its stack."""
    log = "error at " + "/a" * 50_000
    assert spark.createDataFrame([(log,)], "t string").select(S.normalized_log(F.col("t"))).first()[0] == "error at <path>"
