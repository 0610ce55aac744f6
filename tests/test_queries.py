import pytest
from compare import compare, duck

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, sf_dir, name):
    count, problem = compare(spark, connection, sf_dir, QUERIES[name], SQL[name])
    assert problem is None and count > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["term", "term_id", "freq"]
