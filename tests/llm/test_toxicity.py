import zlib

import numpy as np
from pyspark.sql import functions as F

from seqtrend.llm import toxicity as S


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = S.op5(spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [(label[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in label]
    y, score, p = map(np.array, zip(*test))
    precision, recall = (y & p).sum() / p.sum(), (y & p).sum() / y.sum()
    assert precision > 0.9 and recall > 0.82, (precision, recall)
    assert np.mean((score - y) ** 2) < 0.03


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.random(3000)
    xs, ys = S.isotonic([(float(v), int(rng.random() < v**2)) for v in x])
    assert xs == sorted(xs) and ys == sorted(ys) and len(xs) <= 64
    assert np.abs(np.interp([0.2, 0.5, 0.8], xs, ys) - np.array([0.04, 0.25, 0.64])).max() < 0.1


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, None), (None, 1, 1), (5, 1, 0), (5, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    one = S.fit(odd_docs, labels).scored(odd_docs)
    assert one.count() == odd_docs.count()
    bad = spark.createDataFrame([(i, ("you are scum and trash " if i % 3 == 0 else "a fine day by the sea ") * (i % 5 + 1)) for i in range(300)], "doc_id long, text string")
    marks = bad.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = S.fit(bad, marks)
    assert model.trees is not None
    got = model.scored(odd_docs, "start").collect()
    assert len(got) == odd_docs.count() and all(0 <= r.start <= 1 for r in got)
    assert model.scored(no_docs).count() == 0
    kept = S.clean(bad.union(spark.createDataFrame([(999, None), (None, "")], "doc_id long, text string")), marks)
    assert kept.count() == 202 and kept.columns == ["doc_id", "text"]
