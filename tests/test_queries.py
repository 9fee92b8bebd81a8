import glob
import os

import duckdb
import pytest

from loomgraph import registry

NAMES = sorted(registry.SQL)


def same(v):
    return float(v) if type(v).__name__ in ("Decimal", "float") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    ours = sorted((tuple(same(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = duck.execute(registry.SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    theirs = sorted((tuple(same(r[cols.index(c)]) for c in names) for r in cur.fetchall()), key=repr)
    assert [repr(r) for r in ours] == [repr(r) for r in theirs]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["src_emotion", "dst_emotion", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
