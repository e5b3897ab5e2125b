"""Every registered query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from polyspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert rows(catalogue.queries()[name](spark, SF).toPandas()) == rows(con.execute(catalogue.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
