import re
from collections import Counter, defaultdict

import pytest

from seqtrend.llm import divergence as D


def brute(rows, least, top=10):
    """Every document by itself; every pair over all kept terms."""
    lower = str.maketrans(D.UPPER, D.LOWER)
    docs, counts = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        words = re.findall(D.TERM, (text or "").translate(lower))
        counts[lang or ""][source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(c):
            under = sum(c[x] for x in kept) + 2 * len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 2) // under for t in kept}  # noqa: B023

        f = lambda p, q: (p - q) ** 2 // (p + q)
        every = Counter()
        for c in groups.values():
            every.update(c)
        p, q = {s: share(c) for s, c in groups.items()}, share(every)
        for s, c in groups.items():
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 10, 40, 10_000])
def test_against_brute_force(spark, sf, least):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()], least)
    assert sorted(tuple(r) for r in D.audit(docs, least).collect()) == want and len(want) > 20


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    for least in (1, 2):
        got = D.audit(odd_docs, least).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, least)
    assert D.audit(no_docs).collect() == []


def test_ties_and_letters(spark):
    rows = [("Äb äB ab AB zz", "de", s) for s in "pqr"] * 4 + [("b a B A", "en", "x")] * 11 + [("", "en", "y"), (None, None, None), ("123 ..", "fr", "x"), ("_", "fr", "y")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in D.audit(df).collect()) == brute(rows, 10)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_repeats_are_tokenised_once(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_ROWS", most)
    rows = [("same words in a text", "en", s) for s in "ab" for _ in range(500)] + [("other words", "en", "a")] * 10 + [("same words in a text", "de", "b"), ("alone", "en", "c")]
    texts = D.collapsed(*D.text_counts(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4))).collect()
    want = [("de", "same words in a text", [("b", 1)]), ("en", "alone", [("c", 1)]), ("en", "other words", [("a", 10)]), ("en", "same words in a text", [("a", 500), ("b", 500)])]
    assert sorted((r.lang, r.text, sorted((s.source, s.m) for s in r.sources)) for r in texts) == want
