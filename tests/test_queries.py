"""Every query that has SQL agrees with it; the others return rows."""

import __spark_entry__ as e
import harness
import pytest
from codexa.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert harness.differences(plans.QUERIES[name](spark, SF), con, plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_returns_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
