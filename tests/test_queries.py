"""Every query with a SQL counterpart is named for one that exists; each is
compared row by row with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from workload.oracle import SQL
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer documents events orders pages conversations supplier".split()

def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    answer = con.execute(SQL[name])
    names = [column[0] for column in answer.description]
    wanted = sorted(map(repr, ({n: r[i] for i, n in sorted(enumerate(names), key=lambda p: p[1])} for r in answer.fetchall())))
    frame = QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    got = sorted(repr({n: row[n] for n in sorted(names)}) for row in frame.collect())
    assert got == wanted
