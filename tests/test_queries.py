"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import pytest

from gramlake.plans import ORACLES, QUERIES
from oracle import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 45
    assert set(e.oracle_sql()) <= set(e.queries())
