"""Every query that has SQL, against another engine on the smallest tables; the others by their shape."""

import glob
import math
import os
from collections import Counter

import __spark_entry__ as entry
import duckdb
import pytest

CORE = [q for m in entry.MODULES for q in m.QUERIES]
CORE_SQL = {k: v for m in entry.MODULES for k, v in m.SQL.items()}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return plain(tuple(v)) if hasattr(v, "asDict") else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(spark, sf_dir, duck, name, sql):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    same(spark, sf_dir, duck, name, CORE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(CORE_SQL)))
def test_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
