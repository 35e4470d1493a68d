import pytest
from oracle import compare, connect

import __spark_entry__

DIR = "/root/testdata/sf0.001"
NAMES = sorted(n for n in __spark_entry__.queries() if n.startswith("op"))


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n in NAMES if n in __spark_entry__.oracle_sql()])
def test_query_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], DIR)
    assert ok, message
