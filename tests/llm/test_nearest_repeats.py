import random

from seqtrend.llm import nearest as S


def test_repeated_rows_count_once(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    once = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    twice = once.union(once)
    want = S.search(once, once.where("vec_id < 3")).orderBy("query_id", "rank").collect()
    assert len(want) == 30 and len({(r.query_id, r.vec_id) for r in want}) == 30
    assert S.search(twice, twice.where("vec_id < 3")).orderBy("query_id", "rank").collect() == want
