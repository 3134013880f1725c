import pytest

import __spark_entry__ as entry
from textloom.plans import catalogue as registry, evidence

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(agrees, name):
    agrees(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_without_oracle(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_counterfactuals_match_their_slow_sql(agrees):
    agrees(registry.QUERIES["counterfactuals"], evidence.COUNTERFACTUALS)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
