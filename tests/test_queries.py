import compare
import pytest
from conftest import SF

from ledgerlake.plans import registry

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    query = registry.queries()[name]
    if name in ORACLE:
        assert compare.differences(spark, compare.connect(SF), SF, query, ORACLE[name]) == ""
    else:
        assert query(spark, SF).count() > 0


def test_hybrid_candidates(spark):
    """The 3 k nearest vectors take part, as in the reference; the oracle's own limit is k."""
    sql = ORACLE["rg4_hybrid"].replace("vec_id limit 10)", "vec_id limit 30)")
    assert compare.differences(spark, compare.connect(SF), SF, registry.queries()["rg4_hybrid"], sql) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
