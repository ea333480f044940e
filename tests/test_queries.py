"""Each registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sorrel.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    cur = duck.execute(registry.oracle_sql()[name])
    cols, want = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert a == sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in want), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
