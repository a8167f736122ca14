import random
import re

import corpus_pipeline as P

from seqtrend.llm import near_duplicates as S


def brute_kept(rows):
    """Smallest ids of the components over exact Jaccard of five-word shingles of all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(d, first.get(find(i), d))
    return set(first.values())


def test_stage_against_brute_force(spark, sf):
    """The given documents, and copies in which every 25th word or so is another one: similarity from about 0.7 to 0.95."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng, rows = random.Random(5), [(r.doc_id, r.text) for r in docs.collect()]
    top = max(d for d, _ in rows)
    long = [t for _, t in rows if t and 80 < len(t.split()) < 400][:40]
    for n, t in enumerate(long):
        w = t.split()
        for i in rng.sample(range(len(w)), max(1, len(w) // (25 + n))):
            w[i] = f"other{n}x{i}"
        rows.append((top + 1 + n, " ".join(w)))
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], docs.schema)
    want = brute_kept(rows)
    got = {r.doc_id for r in P.near_duplicates(spark, df, sf).collect()}
    assert got == want and 10 < sum(d > top and d not in want for d, _ in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    kept = S.keep_one_per_group(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and ids.count(1) == 1 and 2 not in ids and 3 not in ids
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 1 and {4, 7, 8, 9} <= set(ids)
    assert S.keep_one_per_group(no_docs).count() == 0
