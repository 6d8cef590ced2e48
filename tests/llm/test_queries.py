import pytest

from strandflow.llm import queries
from tests.compare import SF_DIR, assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF_DIR), queries.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
