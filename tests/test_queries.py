"""Every query with SQL gives the same rows as it; the others run."""

import pytest

from glyphmere import registry
from oracle_check import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    compare(spark, sf, name, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["input", "match", "damerau", "classification"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
