"""Every core query with SQL gives the rows of its SQL."""

import pytest

from ledgerloom.plans import core_queries
from tests.compare import assert_same, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_same_rows(spark, data, con, name):
    assert_same(core_queries.QUERIES[name](spark, data), con, core_queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.SQL)))
def test_runs(spark, data, name):
    df = core_queries.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["tab", "record_key", "utc"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_catalog(spark):
    from ledgerloom.plans.registry import catalog

    assert catalog(spark).where("description = ''").count() == 0
