"""Every query equals its SQL twin; those without one give rows."""

import oracle
import pytest

from voxlake.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, small, name):
    assert oracle.differences(con, catalog.SQL[name], catalog.QUERIES[name](spark, small)) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
