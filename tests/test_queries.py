"""Every named query against its SQL on DuckDB at the smallest scale."""

import pathlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
