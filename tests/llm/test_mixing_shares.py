import pytest
from pyspark.sql import functions as F

from seqtrend.llm import mixing as S


def goals(spark, table, shares):
    return {d: {r[0]: r[1] for r in t.collect()} for d, t in S.targets(table, shares=shares).items()}


def test_explicit_shares(spark):
    rows = [("a", "x", "prose", 600, 1), ("b", "x", "prose", 300, 1), ("c", "y", "prose", 100, 1), ("", "y", "table", 50, 1), ("e", "y", "table", 0, 1)]
    table = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")
    plain = goals(spark, table, None)
    power = {"a": 600**0.7, "b": 300**0.7, "c": 100**0.7, "": 50**0.7}
    assert plain["source"] == {k: pytest.approx(v / sum(power.values())) for k, v in power.items()}
    got = goals(spark, table, {"source": {"a": 0.2, "": 0.1, "e": 0.3, "none": 0.1}, "topic": {"prose": 0.9, "table": 0.0}})
    assert got["source"] == {"a": 0.2, "": 0.1, "b": pytest.approx(0.7 * power["b"] / (power["b"] + power["c"])), "c": pytest.approx(0.7 * power["c"] / (power["b"] + power["c"]))}
    assert got["topic"] == {"prose": pytest.approx(1.0), "table": 0.0} and got["lang"] == plain["lang"]
    for bad in ({"source": {"a": 0.7, "b": 0.4}}, {"lang": {"x": -0.1}}):
        with pytest.raises(ValueError):
            S.targets(table, shares=bad)


def test_documents_are_drawn_to_the_shares(spark):
    text = lambda n: "word " * n
    rows = [(i, text(5 + i % 9), "x" if i % 3 else "y", "web" if i % 5 else "book") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for share in (0.5, 0.05, 0.0):
        drawn = S.mixed(docs, shares={"source": {"book": share}, "lang": {"y": 0.4}}).withColumn("n", S.n_tokens())
        total = drawn.agg(F.sum("n")).first()[0]
        part = lambda c, v: (drawn.where(F.col(c) == v).agg(F.sum("n")).first()[0] or 0) / total  # noqa: B023, E731
        assert abs(part("source", "book") - share) < 0.03 and abs(part("lang", "y") - 0.4) < 0.03
        assert total > 0.25 * docs.agg(F.sum(S.n_tokens())).first()[0]
    assert S.mixed(docs.limit(0), shares={"source": {"web": 1.0}}).count() == 0
