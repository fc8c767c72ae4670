import pytest
from oracle import same

from tidebook.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf)
