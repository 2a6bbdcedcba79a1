import pytest

from quillspark.llm import queries
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, con, name):
    if name in queries.SQL:
        compare(spark, con, data, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, data).count() >= 0
