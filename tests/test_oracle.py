import pytest

import __spark_entry__ as entry
from quillspark.plans import registry
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_names_agree():
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, con, name):
    if name in registry.SQL:
        compare(spark, con, data, registry.QUERIES[name], registry.SQL[name])
    else:
        rows = registry.QUERIES[name](spark, data).count()
        assert rows > 0 or name == "scale_outs"  # the smallest table has no busy minute
