"""Every registered query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from placelens import catalog

SF = "/root/testdata/sf0.001"


def _value(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.6f}"
    return str(x).removesuffix(" 00:00:00")


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_value, r)) for r in df.itertuples(index=False)), list(df.columns)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert _rows(got) == _rows(duck.sql(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count()
