"""Every query of the catalogue against its SQL, at the smallest scale; what the entry offers."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trawl.catalogue import ORACLES, QUERIES

TOP = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TOP}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, TOP).toPandas(), con.sql(ORACLES[name]).df()
    tidy = lambda df: sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))
    assert sorted(ours.columns) == sorted(theirs.columns) and tidy(ours) == tidy(theirs)


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "line_number", "line"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
