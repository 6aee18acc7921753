"""Every query beside its SQL, on the smallest data."""

import pytest
from conftest import DATA
from oracle import assert_same, connect

from furrow.plans import registry


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    found = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLES:
        assert_same(found, con, registry.ORACLES[name])
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["date", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
