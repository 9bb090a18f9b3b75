"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

import pytest

from tessera.plans.registry import ORACLES, QUERIES
from tests.oracle import connection, same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
