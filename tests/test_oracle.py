"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, plain
from workload import registered
from conftest import SMALL

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(registered.ALL) - set(ORACLE) == {"joi_15b_compare_places"}  # see test_versions.py


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, con, key):
    df = QUERIES[key](spark, SMALL)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    got = con.execute(ORACLE[key])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
    assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 1
