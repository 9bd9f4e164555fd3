import pytest
from harness import compare, connection

from tessera.llm import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    assert compare(registry.queries()[name](spark, D), registry.oracle_sql()[name], connection(D)) == ""
