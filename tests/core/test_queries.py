"""Every query runs on the smallest tables and equals its SQL."""

import duckdb
import pytest

import __spark_entry__
from trackloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, f"{v:.5g}")
    if isinstance(v, list | tuple):
        return (2, str([plain(x) for x in v]))
    return (1, str(v))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted([plain(r[i]) for i in at] for r in cursor.fetchall())
    assert sorted([plain(r[c]) for c in columns] for r in df.collect()) == want


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_all_queries_are_registered():
    assert QUERIES.keys() <= __spark_entry__.queries().keys() and ORACLES.keys() <= QUERIES.keys()
