"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from shelfwise.plans import catalog

TABLES = Path("/root/testdata/sf0.001")
SLOW = {"full_plan", "consensus", "lsa"}


def same(v):
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, name):
    df = __spark_entry__.queries()[name](spark, str(TABLES))
    cols = sorted(df.columns)
    got = Counter(repr(tuple(same(r[c]) for c in cols)) for r in df.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    at = [names.index(c) for c in cols]
    assert sorted(names) == cols
    assert got == Counter(repr(tuple(same(float(x[i]) if type(x[i]).__name__ == "Decimal" else x[i]) for i in at)) for x in r.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
