"""Every core query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from fathomwire.plans.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, con, name):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(columns).collect()), key=str)
    assert got
    if name in oracle_sql():
        assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall(), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
