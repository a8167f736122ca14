from seqtrend.operators.evaluate import PIECE, kmer_novelty, kmers


def test_places_are_made_once(spark):
    """Neither the pieces nor their k-mers are made again in a filter; all places of long and short texts are there."""
    text = "".join(chr(65 + (i * i + i // 7) % 26) for i in range(2 * PIECE + 3)) + "\n😀*"
    seqs = [text[:n] for n in (0, 3, 4, 5, PIECE, PIECE + 3, PIECE + 4, 2 * PIECE + 3, 2 * PIECE + 6)] + [None]
    rows = spark.createDataFrame(list(enumerate(seqs)), "i int, seq string").coalesce(1)
    out = kmers(rows, 4, "i")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted((i, s[j : j + 4]) for i, s in enumerate(seqs) if s for j in range(len(s) - 3))


def test_known_samples_make_no_kmers(spark):
    """The k-mers of samples that are known themselves aren't compared."""
    known = spark.createDataFrame([("ABCDEFGHIJKLMNOP",), ("short",)], "seq string")
    samples = spark.createDataFrame([("ABCDEFGHIJKLMNOP",), ("ABCDEFGHIJKLMNOX",), ("short",), ("BCDEFGHIJKLM",)], "seq string")
    out = kmer_novelty(samples, known, 11)
    assert {r.seq: r.novelty for r in out.collect()} == {"ABCDEFGHIJKLMNOP": 0, "ABCDEFGHIJKLMNOX": 1, "short": 0, "BCDEFGHIJKLM": 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 2
