import pytest

from loomgraph.llm.queries import QUERIES, SQL
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, small, name):
    assert differences(spark, duck, name, small, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
