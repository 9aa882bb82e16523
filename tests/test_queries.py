"""Every registered date query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from dateloom.plans.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    found = QUERIES[name](spark, DIR)
    wanted = sql.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert canonical(found.columns, found.collect()) == canonical(wanted.columns, wanted.fetchall())
