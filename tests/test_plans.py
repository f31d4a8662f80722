"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import check, database

from quillspark import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    check(plans.queries()[name](spark, SF), con, plans.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
