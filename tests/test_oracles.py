"""Every registered query of the library against its SQL, over whole tables."""

import compare
import pytest

from rostrum.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equal_to_sql(spark, sf, con, name):
    assert compare.differences(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
