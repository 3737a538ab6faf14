"""Every registered query against its DuckDB oracle on the smallest scale factor."""
import duckdb
import pytest

import __spark_entry__ as E
from concordia.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"
FAST = [n for n in E.oracle_sql() if not n.startswith(("v", "l", "c9"))] + ["v6_audit_verdicts"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in sorted(cols)]
    want = sorted((tuple(norm(row[i]) for i in idx) for row in cur.fetchall()), key=repr)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "verdict" in df.columns
