"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from fathom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiub" or str(df[c].dtype).startswith("Int"):
            df[c] = df[c].astype(float).round(5)
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(found.columns)  # a few queries have no rows at the smallest scale
    if name in catalog.ORACLE_SQL:
        ours, theirs = normal(found), normal(duck.execute(catalog.ORACLE_SQL[name]).df())
        assert list(ours.columns) == list(theirs.columns) and len(ours) == len(theirs)
        for c in ours.columns:
            if ours[c].dtype.kind == "f":
                assert np.allclose(ours[c], theirs[c].astype(float), atol=2e-5, equal_nan=True), c
            else:
                assert (ours[c] == theirs[c]).all(), c


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
