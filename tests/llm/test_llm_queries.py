import pytest

from fathomline.llm import queries
from tests.test_queries import equal_to_sql


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf_dir, name):
    equal_to_sql(spark, sf_dir, queries.QUERIES[name], queries.ORACLE.get(name))
