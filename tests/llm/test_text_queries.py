"""The registered text queries that SQL can express, against their SQL on whole tables."""

import duckdb
import pytest

from ballotcredit.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def comparable(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "embeddings"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    want = engine.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert comparable(got.columns, got.collect()) == comparable(names, want.fetchall())


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
