"""Every query of the engine against DuckDB on the same tables."""

import glob
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from ledgerloom.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def value(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    df, rel = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    ours = sorted(repr(tuple(value(r[c]) for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(value(r[rel.columns.index(c)]) for c in order)) for r in rel.fetchall())
    assert ours == theirs


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 26
    assert set(e.oracle_sql()) <= set(e.queries())
