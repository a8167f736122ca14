import pytest

from seqtrend.llm import common


@pytest.mark.parametrize("task_edges", [0, 200_000])
def test_components_agree_in_one_task_and_in_many(spark, monkeypatch, task_edges):
    monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7), (101, 100)]
    rows = common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["component"], set()).add(r["v"])
    assert sorted(map(sorted, groups.values())) == [list(range(41)), [100, 101, 102]]
    assert all(c in members for c, members in groups.items())


def test_no_edges_no_components(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
