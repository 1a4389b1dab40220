"""The driver contract, and agreement with the SQL twins on the smallest data."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from test_plans import plan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["page_id", "n_blocks", "n_known", "known_share"] and df.count() == 50


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql_without_product_joins(spark, con, name):
    df = queries()[name](spark, SF)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in oracle_sql():
        assert not df.isEmpty()
        return
    cur = con.execute(oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, df.collect()) == want
