"""The driver's contract, and the queries against their SQL twins at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from ocellus.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return str(v)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, name):
    frame = plans.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(value(r[c]) for c in columns)) for r in frame.collect())
    if name not in plans.oracle_sql():
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(value(row[names.index(c)]) for c in columns)) for row in r.fetchall())
