import random
import re
from collections import Counter

from seqtrend.llm import decontaminate as S


def words(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def best_window(doc, item, k=5):
    """Largest weighted similarity over all windows of the item's size."""
    d, i = words(doc), words(item)
    if not i:
        return 0.0
    k = min(k, len(i))
    sh = lambda w: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    a, best = sh(i), 0.0
    for s in range(max(1, len(d) - len(i) + 1)):
        b = sh(d[s : s + len(i)])
        if a and b:
            best = max(best, sum((a & b).values()) / sum((a | b).values()))
    return best


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice((1, 3, 5, 12, 30, 45, 60)))) for i in range(24)] + [(50, None), (51, ""), (52, "ha ha ha ha ha ha ha ha")]
    docs = []
    for n in range(120):
        body = words(text(rng.randint(0, 150)))
        if n % 2:
            w = words(items[rng.randrange(24)][1])
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [rng.choice(vocab)], [w[at], rng.choice(vocab)]))
            at = rng.randint(0, len(body))
            body[at:at] = w
        docs.append((n, (", " if n % 3 else " ").join(body).title()))
    docs += [(200, None), (201, ""), (202, "HA! " * 300), (203, docs[1][1]), (203, docs[1][1]), (None, docs[1][1])]
    docs_df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in S.contaminated(docs_df, bench).collect()}
    want = {(d, i): s for d, t in docs for i, x in items if (s := best_window(t, x)) >= 0.8}
    assert got.keys() <= want.keys() and all(got[k] <= want[k] + 1e-9 for k in got)
    missed = want.keys() - got.keys()  # windows that no shared shingle aligns, and fingerprints beyond the radius
    assert len(missed) <= 0.02 * len(want), missed
    assert all((d, i) in got for d, i in want if want[d, i] > 0.9)
    kept = S.decontaminate(docs_df, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in {d for d, _ in got})


def test_planted_passages(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()}
    got = {(r.doc_id, r.item_id) for r in S.op2(spark, sf).collect()}
    assert got >= {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert all(best_window(texts[d], items[i]) >= 0.8 for d, i in got)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the same words stand here twice over"), (2, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in S.contaminated(odd_docs, bench).collect()) == [5, 6]
    kept = S.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert S.contaminated(no_docs, bench).count() == 0 and S.contaminated(odd_docs, bench.limit(0)).count() == 0
