"""Every query with SQL gives what DuckDB gives for that SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from leafmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(frame, columns):
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "NULL"
        if isinstance(v, (list, np.ndarray)):
            return repr([one(x) for x in v])
        return repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(map(one, row)) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got, columns) == shown(want, columns)
    assert len(got) > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows_only(spark, name):
    frame = catalog.QUERIES[name](spark, SF)
    assert frame.count() > 0 and len(set(frame.columns)) == len(frame.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.exists("bench.py")
