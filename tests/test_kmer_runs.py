"""Many known k-mers are met in runs of places."""

import random

import pytest

from seqtrend.operators import evaluate, kmer_runs


def texts(n, seed, longest=900):
    """Sequences of few words, so that they share k-mers; some shorter than one, and one of a single letter."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=rng.randint(2, 9))) for _ in range(60)]
    rows = ["".join(rng.choices(words, k=rng.randint(1, longest // 6))) + "*" for _ in range(n)]
    return [*rows, "", "*", "A" * 700 + "*"]


def brute(samples, known, k):
    seen = {s[i : i + k] for s in known for i in range(len(s) - k + 1)}
    return {s: 0 if s in known else sum(s[i : i + k] not in seen for i in range(len(s) - k + 1)) for s in samples}


@pytest.mark.parametrize("k", [11, 12, 3])
def test_many_known_kmers_are_met_in_runs(spark, monkeypatch, k):
    """no k-mer is a row of its own, and every place is counted, over batches and buckets too."""
    monkeypatch.setattr(evaluate, "ROWS", 0)
    monkeypatch.setattr(kmer_runs, "BATCH", 2_000)
    monkeypatch.setattr(kmer_runs, "PENDING", 500)
    monkeypatch.setattr(evaluate, "kmers", None)
    samples, known = texts(80, 1), [*texts(50, 1, 300), *texts(5, 2)]
    samples.append(known[3])
    table = lambda x: spark.createDataFrame([(s,) for s in x], "seq string")
    got = {r.seq: r.novelty for r in evaluate.kmer_novelty(table(samples), table([*known, None]), k).collect()}
    assert got == brute(samples, known, k) and any(got.values())


def test_other_letters_are_met_one_by_one(spark, monkeypatch):
    """A letter that five bits don't hold is not taken for another."""
    monkeypatch.setattr(evaluate, "ROWS", 0)
    samples, known = ["ABCDEFGHIJKLMNO", "abcdefghijklmno", "ABCDEFGHIJ😀LMN"], ["ABCDEFGHIJKLMN*", "ABCDEFGHIJ-LMN*"]
    table = lambda x: spark.createDataFrame([(s,) for s in x], "seq string")
    assert {r.seq: r.novelty for r in evaluate.kmer_novelty(table(samples), table(known), 11).collect()} == brute(samples, known, 11)
