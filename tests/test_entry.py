"""Every named query against its SQL on the smallest tables."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.toArrow().to_pylist()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    cols = sorted(d[0] for d in cur.description)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    assert sorted(df.columns) == cols
    a = Counter(str([plain(r[c]) for c in cols]) for r in got)
    b = Counter(str([plain(r[c]) for c in cols]) for r in want)
    assert a == b, (list((a - b))[:2], list((b - a))[:2])
