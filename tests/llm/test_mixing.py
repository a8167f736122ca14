from collections import defaultdict

import numpy as np

from seqtrend.llm import mixing as S


def brute(rows, powers, keep):
    """Raking of a dict of cells; rows: (source, lang, topic, tokens)."""
    cell = defaultdict(int)
    for *key, n in rows:
        cell[tuple(key)] += n
    w = {k: v / sum(cell.values()) for k, v in cell.items()}
    goals = []
    for d, name in enumerate(S.DIMENSIONS):
        sums = defaultdict(float)
        for k, v in cell.items():
            sums[k[d]] += v
        p = {v: s ** powers[name] for v, s in sums.items() if s > 0}
        goals.append({v: x / sum(p.values()) for v, x in p.items()})
    for _ in range(200):
        for d in range(3):
            now = defaultdict(float)
            for k, v in w.items():
                now[k[d]] += v
            w = {k: v * goals[d].get(k[d], 0) / now[k[d]] if now[k[d]] else 0.0 for k, v in w.items()}
    ratio = {k: w[k] / cell[k] for k in cell if cell[k]}
    scale = min(sum(cell.values()) * keep, 1 / max(ratio.values()))
    return {k: min(1.0, ratio[k] * scale) if k in ratio else 1.0 for k in cell}, goals


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys = {r.doc_id: (r.source or "", r.lang or "", r.text) for r in docs.collect()}
    got = S.op4(spark, sf).collect()
    rows = [(*keys[r.doc_id][:2], r.topic, r.n_tokens) for r in got]
    assert all(r.n_tokens == len(keys[r.doc_id][2].split()) for r in got if keys[r.doc_id][2].isascii())
    want, goals = brute(rows, S.POWERS, S.KEEP_SHARE)
    for r in got:
        assert abs(r.probability - want[(*keys[r.doc_id][:2], r.topic)]) < 1e-5
    # Expected tokens meet every target share.
    for d in range(3):
        sums = defaultdict(float)
        for key, r in zip(rows, got):
            sums[key[d]] += r.n_tokens * r.probability
        total = sum(sums.values())
        assert all(abs(sums[v] / total - g) < 1e-4 for v, g in goals[d].items())
    drawn = np.array([r.drawn for r in got])
    assert abs(drawn.mean() - np.mean([r.probability for r in got])) < 0.06
    assert sorted(r.doc_id for r in S.mixed(docs).collect()) == sorted(r.doc_id for r in got if r.drawn)


def test_both_ways_of_raking_agree(spark):
    table = S.cells(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    goals = S.targets(table)
    one, other = ({(r.source, r.lang, r.topic): r.weight for r in S.rake(table, goals, sweeps=6, task_cells=n).collect()} for n in (10_000, 0))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one)


def test_odd_rows(spark, odd_docs, no_docs):
    out = S.mixed(odd_docs, keep_share=1.0)
    assert out.columns == odd_docs.columns and out.count() <= odd_docs.count()
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 in ids and ids.count(6) in (0, 2)
    assert S.mixed(no_docs).count() == 0
    assert S.mixed(odd_docs.where("doc_id = 2")).count() == 1
