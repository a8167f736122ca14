import pytest
from oracle import compare

from seqtrend.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.01", name, registry.QUERIES[name], registry.ORACLES[name]) > 0


def test_sharding_query_splits(spark):
    assert registry.QUERIES["op9_sharding"](spark, "/root/testdata/sf0.01").select("shard_id").distinct().count() > 4
