"""Every registered query with SQL against DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quarryloom.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool | np.bool_):
        return str(bool(value))
    if hasattr(value, "__float__") and not isinstance(value, str):
        return str(round(float(value), 5))
    return str(value)


def rows(table, columns):
    return sorted(tuple(plain(v) for v in r) for r in table[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
