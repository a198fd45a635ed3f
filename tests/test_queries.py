"""Every registered query against its SQL."""

import pytest

from caseweave.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(catalogue.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert catalogue.queries()[name](spark, sf_dir).count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
