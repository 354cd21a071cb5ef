"""Every registered query against its check SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.oracle import compare
from tidewright.plans import registry

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    problem, _ = compare(spark, sf_dir, name, QUERIES[name], ORACLES[name])
    assert not problem


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(registry.QUERIES) <= set(ORACLES)
