import pytest
from oracle import compare

from seqtrend.plans import files, queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, name):
    compare(spark, sf, name, queries.QUERIES[name], queries.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
