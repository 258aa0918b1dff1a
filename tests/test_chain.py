"""Chained queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from groundwell import chain_queries
from groundwell.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
NAMES = [n for n, f in QUERIES.items() if f.__module__ == chain_queries.__name__]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_chained_queries_equal_sql(spark, con, name):
    r = con.execute(SQL[name])
    columns = sorted(c[0] for c in r.description)
    at = [[c[0] for c in r.description].index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == columns
    assert sorted((tuple(plain(row[c]) for c in columns) for row in got.collect()), key=repr) == expected
