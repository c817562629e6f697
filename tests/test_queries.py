"""Every query against its SQL on the smallest tables; queries without SQL against invariants."""

import pytest

from tests.conftest import SF, rows_of
from tessera.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = rows_of(registry.QUERIES[name](spark, SF).toPandas())
    want = rows_of(duck.execute(registry.ORACLES[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
