"""Every query with SQL against DuckDB on the small tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from textloom import catalog


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(df, columns):
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
