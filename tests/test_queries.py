"""Every registered query against its checking SQL at the smallest scale.

The local polynomials run one scale up: the smallest has samples with as many candidates as
coefficients, where neither side of the comparison has four stable digits.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from ballotcredit.workload.queries import QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def sql_engines():
    engines = {}
    for folder in (SMALL, LARGER):
        engines[folder] = duckdb.connect()
        for name in TABLES:
            engines[folder].execute(
                f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return engines


def comparable(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data),
                  key=lambda r: [(v is not None, str(v)) for v in r])


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql_engines, name):
    folder = LARGER if name.startswith("rd_") else SMALL
    df = entry.queries()[name](spark, folder)
    result = sql_engines[folder].execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, result.fetchall())


def test_entry(spark):
    assert "vote_margin" in entry.entry(spark).columns
