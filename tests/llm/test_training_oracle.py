import compare
import pytest
from conftest import SF

from ledgerlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert compare.differences(spark, compare.connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) == ""
