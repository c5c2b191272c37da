"""Every query against its SQL in another engine, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: queries of the text and formula package are compared in its own tests
ORACLE = {k: v for part in entry._PARTS if part is not entry.llm_queries for k, v in part.ORACLE.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        v = df[c]
        if v.dtype == object or not pd.api.types.is_numeric_dtype(v):
            out[c] = v.map(lambda x: "" if x is None or x is pd.NaT or x != x else str(pd.Timestamp(x)) if hasattr(x, "year") else str(x))
        else:
            out[c] = pd.to_numeric(v).astype(float)
    return pd.DataFrame(out).sort_values(sorted(out)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = plain(entry.queries()[name](spark, SF).toPandas()), plain(duck.execute(ORACLE[name]).df())
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
