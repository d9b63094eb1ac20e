"""Every query with SQL gives the rows of its oracle."""

import oracle_compare
import pytest

from upland.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_oracle(name, spark, sf_dir, con):
    wrong, ours, theirs = oracle_compare.differences(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], con)
    assert not wrong
    assert not ours and not theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_learned_query_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
