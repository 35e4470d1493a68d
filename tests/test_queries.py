"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SF)
    assert ok, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["combo_id", "prompt_name", "prompt", "prompt_hash", "hash_prefix"]


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
