import random
from collections import defaultdict

import numpy as np

from seqtrend.llm import substring_dedup as S


def lines_of(text, min_words):
    at, out = 0, []
    for line in (text or "").encode().lower().split(b"\n"):
        w = line.split()
        if len(w) >= min_words:
            out.append((at, tuple(w)))
        at += len(w)
    return out


def brute_paragraphs(rows, min_words=S.MIN_WORDS):
    """{(doc, start): component} over exact Jaccard of all pairs of paragraphs, components over two documents or more."""
    units = [(d, s, w, frozenset(w[i : i + 5] for i in range(len(w) - 4))) for d, t in rows for s, w in lines_of(t, min_words)]
    parent = list(range(len(units)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (*_, a) in enumerate(units):
        for j in range(i):
            b = units[j][3]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(set)
    for i, (d, s, *_) in enumerate(units):
        groups[find(i)].add((d, s))
    return {frozenset(g) for g in groups.values() if len({d for d, _ in g}) > 1}


def test_paragraphs_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = defaultdict(set)
    for r in S.op3(spark, sf).where("kind = 'paragraph'").collect():
        got[r.component_id].add((r.doc_id, r.start_word))
    want = brute_paragraphs(rows)
    assert len({frozenset(g) for g in got.values()} ^ want) <= 0.01 * len(want)


def test_short_lines_are_paragraphs_on_demand(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    footers = [words(n) for n in (5, 6, 12, 30, 45)]
    docs = []
    for i in range(40):
        lines = [words(rng.randint(1, 60)) for _ in range(3)]
        line = list(footers[i % 5])
        if len(line) > 40 and i % 2:
            line[-1] = "edited"
        lines.insert(rng.randint(0, 3), line)
        docs.append((i, "\n".join(" ".join(x) for x in lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = defaultdict(set)
    for r in S.repeats(df, min_words=5).where("kind = 'paragraph'").collect():
        got[r.component_id].add((r.doc_id, r.start_word))
    want = brute_paragraphs(docs, 5)
    assert {frozenset(g) for g in got.values()} == want and len(want) == 5
    assert S.repeats(df).where("kind = 'paragraph'").isEmpty()
    left = "\n".join(r.text for r in S.without_repeats(df, min_words=5).collect()).split("\n")
    assert all(sum(x == " ".join(f) for x in left) == 1 for f in footers)


def test_chain_and_group(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(120)
    docs, cur = [], list(base)
    for i in range(12):  # a chain: neighbours are similar, ends are not
        docs.append((i, " ".join(cur)))
        cur = [*cur[4:], *words(4)]
    for i in range(20, 60):
        w = list(base)
        w[rng.randrange(120)] = "other"
        docs.append((i, " ".join(w)))
    docs += [(i, " ".join(words(100))) for i in range(100, 130)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = S.repeats(df).where("kind = 'paragraph'").collect()
    got = defaultdict(set)
    for r in rows:
        got[r.component_id].add((r.doc_id, r.start_word))
    assert {frozenset(g) for g in got.values()} == brute_paragraphs(docs)
    assert sum(r.kept for r in rows) == len(got)


def test_embedded_passages(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [words(rng.randint(50, 90)) for _ in range(30)]
    docs = []
    for i in range(90):
        body = words(rng.randint(0, 200))
        if i < 60:
            at = rng.randint(0, len(body))
            body[at:at] = passages[i % 30]
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = S.repeats(df)
    assert {r.doc_id for r in found.collect()} == set(range(60))
    left = {r.doc_id: r.text for r in S.without_repeats(df).collect()}
    assert sum(len(t.split()) for t in left.values()) < sum(len(t.split()) for _, t in docs) - 30 * S.WINDOW + 1
    assert all(left[i] == docs[i][1] for i in range(60, 90))


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    monkeypatch.setattr(S, "SMALL", 2)
    test_chain_and_group(spark)


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60_000, n)) for n in (0, 5, 20_000, 30_000, 1)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert S.common_counts(sets, sets).tolist() == want


def test_winnow_guarantee():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    picks = S.winnow(h, 19)
    assert all(((picks >= i) & (picks < i + 19)).any() for i in range(500 - 18))


def test_odd_rows(spark, odd_docs, no_docs):
    assert S.repeats(odd_docs).count() == 0 and S.repeats(no_docs).count() == 0
    out = S.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    text = " ".join(f"w{i}" for i in range(60))
    same = spark.createDataFrame([(None, text), (None, text), (3, text), (4, "ha " * 500), (5, "ha " * 400)], "doc_id long, text string")
    assert {r.doc_id for r in S.repeats(same).collect()} == {None, 3, 4, 5}
