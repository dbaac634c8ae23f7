"""Runs of words against a walk over all periods, and the query against its contract by hand."""

import hashlib
import random
import re
import time
import zlib

import numpy as np

from cohortlens.llm import queries, runs
from cohortlens.llm.base import mix64

rnd = random.Random(11)


def by_hand(w, least=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            s = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            n = i - s
            if n >= max(least, times * q) and not any(all(w[k] == w[k - d] for k in range(s + d, i)) for d in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words():
    k = rnd.choice([1, 2, 2, 3, 4, 50])
    w = [rnd.randrange(k) for _ in range(rnd.randint(0, 60))]
    if rnd.random() < 0.6:
        w[len(w) // 3 : len(w) // 3] = [rnd.randrange(k) for _ in range(rnd.randint(1, 6))] * rnd.randint(2, 9)
    return w


def test_automaton_finds_all_runs():
    for least, times in ((6, 4), (3, 3), (9, 5)):
        for _ in range(500):
            w = some_words()
            assert runs.runs_of(w, least, times) == by_hand(w, least, times)


def test_stretches_hold_runs_whole():
    for least, times in ((6, 4), (3, 3), (9, 5)):
        for _ in range(300):
            many = [some_words() for _ in range(4)]
            flat = np.array([x for w in many for x in w], np.uint64)
            doc = np.repeat(np.arange(4), [len(w) for w in many])
            got = []
            for a, b in zip(*runs.stretches(mix64(flat + np.uint64(5)), doc, runs.gram(least, times), times)):
                got += [(int(doc[a]), s + a, n, q) for s, n, q in runs.runs_of(flat[a:b].tolist(), least, times)]
            at = np.searchsorted(doc, np.arange(4))
            assert sorted(got) == sorted((k, s + at[k], n, q) for k, w in enumerate(many) for s, n, q in by_hand(w, least, times))


def test_long_stretch_in_packed_arrays():
    block = [rnd.randrange(300) for _ in range(40_000)]
    began = time.time()
    assert runs.runs_of(block * 5) == [(0, 200_000, 40_000)]
    assert runs.runs_of([0] * 250_000) == [(0, 250_000, 1)]
    assert time.time() - began < 60


def contract(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = by_hand(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    one = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *one, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w[i] for i in range(n) if i not in gone)))


def test_query_is_the_contract(spark, tmp_path):
    texts = [None, "", " \t\n", "la " * 30, "x y x y " * 9, "É é É é É é É é", "one", "😀 " * 7 + "a b a b a b a b c"]
    rows = [(i, texts[i % len(texts)] if i < 24 else " ".join(f"w{x}" for x in some_words())) for i in range(600)]
    rows += [(3, "la " * 30), (3, "la " * 30), (None, "a a a a a a a"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS collapsed", "3 AS `__n`").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_word_runs(spark, str(tmp_path))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(contract(*r)) for r in rows)
    assert dict(got.dtypes)["exponent_milli"] == dict(got.dtypes)["n_runs"] == "bigint"


def test_own_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("k", "a a a a a a b", "old")], "id string, body string, runs string")
    (row,) = runs.collapse_runs(df, text_col="body").collect()
    assert (row.id, [tuple(r) for r in row.runs], row.collapsed) == ("k", [(0, 6, 1)], "a b")
    assert runs.collapse_runs(df.limit(0), text_col="body").count() == 0


def test_loops_in_linear_time(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.repeat(F.lit("aa b "), 100_000).alias("text"))
    began = time.time()
    (row,) = runs.collapse_runs(df.select(runs.looped(F.col("text"), F.lit(1), F.lit(2)).alias("text"))).collect()
    assert [tuple(r) for r in row.runs] == [(0, 200_000, 2)] and row.collapsed == "aa b" and time.time() - began < 60
