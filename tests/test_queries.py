"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(df):
    plain = lambda x: None if x is None or (isinstance(x, float) and x != x) else bool(x) if isinstance(x, bool | np.bool_) else int(x) if isinstance(x, int | np.integer) else x
    return sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, con, name):
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    out = entry.entry(spark)
    assert isinstance(out.limit(1).toPandas(), pd.DataFrame) and out.count() > 0
