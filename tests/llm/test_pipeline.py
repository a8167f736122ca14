import corpus_pipeline as P
import pytest
from test_decontaminate import best_window
from test_near_duplicates import brute_kept

from seqtrend.llm import mixing, sharding, toxicity


def test_stages_against_brute_force(spark, sf):
    """Each stage's rows follow from its input by the plain rules of its operator."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    inputs, outputs = [], []
    for _, stage in P.STAGES:
        inputs.append({r.doc_id: r for r in docs.collect()})
        docs = stage(spark, docs, sf)
        outputs.append({r.doc_id: r for r in docs.collect()})
        docs = spark.createDataFrame(list(outputs[-1].values()), docs.schema)
    for before, after in zip(inputs[:-1], outputs[:-1]):
        assert all(after[d] == before[d] for d in after)
    scores = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels).scored(spark.read.parquet(f"{sf}/documents.parquet"))
    assert set(outputs[0]) == {r.doc_id for r in scores.collect() if r.score < 0.5}
    assert set(outputs[1]) == brute_kept([(d, r.text) for d, r in inputs[1].items()])
    bench = [r.text for r in items.collect()]
    assert set(outputs[2]) == {d for d, r in inputs[2].items() if max(best_window(r.text, b) for b in bench) < 0.8}
    again = spark.createDataFrame(list(inputs[3].values()), spark.read.parquet(f"{sf}/documents.parquet").schema)
    drawn = mixing.calibrated(again).where(mixing.uniform(17) < mixing.F.col("_llm_probability"))
    assert set(outputs[3]) == {r.doc_id for r in drawn.collect()} and 0.2 < len(outputs[3]) / len(inputs[3]) < 0.9
    assert set(outputs[4]) == set(inputs[4]) and all(r.shard_id == 1 for r in outputs[4].values())
    assert sharding.LIMIT_BYTES > sum(len(r.text.encode()) for r in inputs[4].values())
    assert {r.doc_id for r in P.run(spark, sf).collect()} == set(outputs[4])


@pytest.mark.parametrize("i", range(len(P.STAGES)))
def test_odd_rows(spark, sf, odd_docs, no_docs, i):
    """Nulls, empty and long texts, ties, repeats, an empty table and clashing columns at every stage."""
    name, stage = P.STAGES[i]
    docs = odd_docs.drop("_k")
    out = stage(spark, docs, sf)
    rows = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(rows) <= docs.count()
    ids = [r.doc_id for r in rows]
    if name == "toxicity":
        assert ids.count(6) in (0, 2)
    elif name == "near_duplicates":
        assert len(rows) == 7 and ids.count(None) == 1 and 5 in ids and 6 not in ids
    elif name == "mixing":
        assert ids.count(6) in (0, 2)
    else:
        assert len(rows) == docs.count()
    assert stage(spark, no_docs.drop("_k"), sf).count() == 0
