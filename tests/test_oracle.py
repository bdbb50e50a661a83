"""Every core query with SQL gives the rows of the SQL, over whole tables."""

import glob
import math
import os

import duckdb
import pytest

from lodeline.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def canon(rows):
    def key(v):
        if isinstance(v, float):
            return round(v, 9) if math.isfinite(v) else str(v)
        return str(v) if isinstance(v, list | dict | tuple) else v

    return sorted((tuple(key(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck.execute(registry.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    assert canon(got) == canon(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
