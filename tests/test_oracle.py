"""Each registered query of the library against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from cohortlens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (bool, int, type(None))):
        return v
    return round(float(v), 6) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    got = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_query_has_rows_or_a_twin():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) - len(catalog.ORACLES) <= 3
