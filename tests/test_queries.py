"""Every registered query against its DuckDB text, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check_queries import digest
from querygrove.plans.fixtures import TABLES

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.count() > 0
        return
    rows = [tuple(r) for r in df.collect()]
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, rows)[1] == digest(columns, cursor.fetchall())[1]


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert {"prompt", "answer", "split"} <= set(df.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
