import os

import pytest

import __spark_entry__ as entry
from spanloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.QUERIES) > 70


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda x: None if x is None else str(x).replace("+00:00", "")
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = con.execute(registry.ORACLES[name])
    assert sorted(d[0] for d in result.description) == columns
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(str([plain(r[k]) for k in at]) for r in result.fetchall())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["key", "first", "last", "form", "gloss"]
