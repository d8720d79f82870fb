"""Every query of the core that has SQL, side by side with it; the rest at least run."""

import pytest

from riskloom.plans import catalog
from sql_check import assert_same, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, sf, con, name):
    assert_same(spark, con, sf, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
