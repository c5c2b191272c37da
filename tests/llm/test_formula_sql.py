"""Queries of the package that SQL can express, against it in another engine, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from lodestrata.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = Q.QUERIES[name](spark, SF), con.execute(Q.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
