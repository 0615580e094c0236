"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from passagebase.jobs.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def compare(rows, columns, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(columns)
    order = sorted(names)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in got.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in order)) for r in rows) == want


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    df = queries()[name](spark, DIR)
    compare(df.collect(), df.columns, oracle_sql()[name])
