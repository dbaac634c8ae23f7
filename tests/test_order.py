"""Prefix sums, ranks and medians against plain Python, on odd, even, tied, skewed and single-row groups."""

import random
import statistics

from pyspark.sql import functions as F

from cohortlens.operators import order

rnd = random.Random(5)
GROUPS = {
    "odd": [rnd.random() for _ in range(101)], "even": [rnd.random() for _ in range(100)], "one": [3.5], "two": [1.0, 2.0], "ties": [rnd.choice([1.0, 2.0, 2.5]) for _ in range(200)], "same": [7.0] * 50,
    "skewed": [0.0] * 900 + [10.0**k for k in range(20)], "wide": [rnd.uniform(-1e300, 1e300) for _ in range(500)], "signs": [-1.0, -0.0, 0.0, 1.0], "halves": [1.0] * 50 + [2.0] * 50, "hot": [rnd.randint(0, 5000) / 7 for _ in range(20_000)],
}


def table(spark):
    rows = [(k, v) for k, vs in GROUPS.items() for v in vs] + [("odd", None)] * 5 + [("none", None)]
    return spark.createDataFrame(rnd.sample(rows, len(rows)), "g string, v double").repartition(5)


def test_medians(spark):
    for ranges in (1, 16, 300):
        got = {r.g: (r.median, r.n_rows) for r in order.exact_median(table(spark), "v", ["g"], ranges=ranges).collect()}
        assert got == {k: (statistics.median(vs), len(vs) + 5 * (k == "odd")) for k, vs in GROUPS.items()} | {"none": (None, 1)}
    assert order.exact_median(table(spark).limit(0), "v", ["g"]).count() == 0


def test_prefix_sums_whatever_the_ranges(spark):
    for ranges in (1, 7, 64):
        got = sorted(map(tuple, order.prefix_sums(table(spark), "v", ["g"], ranges).collect()))
        want = []
        for k, vs in GROUPS.items():
            want += [(k, x, vs.count(x), sum(y < x for y in vs), len(vs)) for x in {v + 0.0 for v in vs}] if k != "hot" else []
        assert [r for r in got if r[0] != "hot"] == sorted(want)
        hot = [r for r in got if r[0] == "hot"]
        assert [r[3] for r in hot] == [sum(r[2] for r in hot[:i]) for i in range(len(hot))] and hot[0][4] == 20_000


def test_ranges_rise_with_values(spark):
    vs = sorted([rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-320, 308) for _ in range(2000)] + [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, -1.0]) + [float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([float("-inf"), *vs])], "i int, v double")
    got = [r.r for r in df.select("i", order.magnitude(F.col("v")).alias("r")).orderBy("i").collect()]
    assert got == sorted(got)


def test_ranks(spark):
    got = {(r.g, r.v): r.rank for r in order.average_rank(table(spark), "v", ["g"], "rank").collect()}
    for k in ("odd", "ties", "skewed", "halves"):
        vs = GROUPS[k]
        for x in set(vs):
            assert got[k, x] == sum(y < x for y in vs) + (vs.count(x) + 1) / 2
    assert all(v is not None for _, v in got)


def test_one_group_is_sorted_in_ranges(spark):
    """No window over values is partitioned by the group alone."""
    plan = order.prefix_sums(table(spark), "v", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "v#" in x.split("windowspecdefinition")[-1]]
    assert windows and all("__range#" in x.split("windowspecdefinition(")[1].split("ASC")[0] for x in windows)
    part = table(spark).where(F.col("g") == "hot")
    assert order.prefix_sums(part, "v", ["g"]).count() == len(set(GROUPS["hot"]))
