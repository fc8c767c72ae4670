import pytest
from oracle import same

import __spark_entry__
from tidebook.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLE[name], sf)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
