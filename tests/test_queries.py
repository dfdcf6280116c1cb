from __future__ import annotations

import glob

import duckdb
import pytest

from lodestream.plans import ENTRY, QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, map(tuple, df.select(cols).collect())))
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert got == sorted(map(str, want))


def test_entry_has_rows(spark):
    assert ENTRY(spark, SF).count() > 0
