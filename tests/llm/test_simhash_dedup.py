import re

import xxhash

from seqtrend.llm import simhash_dedup as S


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    first = {}
    for d, p in prints:
        if d is not None:
            first[find(p)] = min(d, first.get(find(p), d))
    return sorted(((d, f"{p:016x}", first.get(find(p))) for d, p in prints), key=str)


def test_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r)[:3] for r in S.op8(spark, sf).collect()), key=str)
    assert got == brute_groups(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in S.simhash_groups(odd_docs).collect()), key=str)
    assert got == brute_groups(rows)
    assert S.simhash_groups(no_docs).count() == 0
    kept = S.keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and ids.count(1) == 1 and 2 not in ids and ids.count(None) == 1


def test_close_prints_all_found(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), n)) for b in base for n in (0, 1, 2, 3, 4) for _ in range(6)}
    want = {(min(a, b), max(a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.linked_prints(df, 2).collect()]
    assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == want


def test_components(spark):
    from seqtrend.llm.common import connected_components

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 200)] + [(500, i) for i in range(300, 340)]
    labels = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({labels[i] for i in range(61)}) == 1 and len({labels[i] for i in (100, 101, 102)}) == 1
    assert len({labels[i] for i in range(300, 340)} | {labels[500]}) == 1 and len(set(labels.values())) == 3
