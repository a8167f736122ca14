"""The evaluation job moves digests, not texts."""

from seqtrend.jobs import evaluate as job


def test_ranks_of_ties_without_texts(spark, monkeypatch):
    """F1: ranks are made without texts, but for those that order samples of one run and score; several runs share a text."""
    made, real = {}, job.stored
    monkeypatch.setattr(job, "stored", lambda df, name: made.setdefault(name, real(df, name)))
    seqs = ["CDEFGHIKLMN*", "AEEFGHIKLMN*", "AEXFGHIKLMN*", "WWW*", "W[X]*"]
    rows = [("a-1", s, 1.0) for s in seqs] + [("a-2", s, float(i)) for i, s in enumerate(seqs[:3])] + [("a-2", seqs[3], None), ("a-2", None, 2.5)]
    obs = spark.sql("select 'A1C' as m, 'CDEFGHIKLMN*' as seq, date '2021-01-01' as d, 'x' as acc, 'L' as lineage")
    out = job.run(spark.createDataFrame(rows, "run string, seq string, score double"), obs, "2021-01-05", 2, 2)
    assert "seq" not in made["flags"].columns and "seq" not in made["ranked"].columns
    got = sorted((r.run, r["rank"], r.seq) for r in out["classified"].collect())
    assert got == [("a-1", i, s) for i, s in enumerate(sorted(seqs), 1)] + [("a-2", i, s) for i, s in enumerate([None, seqs[2], seqs[1], seqs[0], seqs[3]], 1)]
    assert {(r.run, r.n_valid) for r in out["stats"].collect()} == {("a-1", 3), ("a-2", 3)}
