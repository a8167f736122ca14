from seqtrend.llm import near_duplicates
from seqtrend.llm.simhash_dedup import fingerprint

WORDS = [f"word{i}" for i in range(120)] * 20


def test_fingerprints_make_candidates(spark):
    """Texts linked by their fingerprints are compared, whatever MinHash bands they share."""
    a = " ".join(WORDS)
    changed = (" ".join([*WORDS, *(f"tail{k}x{j}" for j in range(40))]) for k in range(2000))
    b = next(t for t in changed if 0 < (fingerprint(t) ^ fingerprint(a)).bit_count() <= 2)
    docs = spark.createDataFrame([(1, a), (2, b), (3, "other words that stand alone in this table"), (4, ""), (5, None)], "doc_id long, text string")
    bands = {r.doc_id: r.bands for r in near_duplicates.candidates(docs).collect()}
    assert len(bands[1]) == 11 and bands[1][-1] == bands[2][-1] != bands[3][-1] and bands[4] is bands[5] is None
