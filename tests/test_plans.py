import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seqtrend.functions import mutations
from seqtrend.operators import evaluate, kmer_index, matching, pairs, wildcards
from seqtrend.sources.scratch import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_helpers_stay_above_the_distinct(spark):
    """A filter that a later join infers must not take the alignment below the distinct."""
    rows = spark.createDataFrame([("ACD*",), ("AD*",)], "seq string")
    made = mutations.align_mutations(rows, "ACD*")
    joined = made.join(made.select("m").distinct().withColumn("n", F.lit(1)), "m")
    for part in plan(joined).split("ArrowEvalPython")[1:]:
        assert "HashAggregate(keys=[seq" in part


def made_series(spark, n, weeks=30, hot=0.4, seed=3):
    """Variants with skewed totals, of which a share is first seen in one week."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        week = 11 if rng.random() < hot else rng.randrange(weeks - 8)
        total = int(10 ** rng.uniform(0, 4.5))
        steps = sorted(rng.randint(1, total) for _ in range(weeks - week - 1)) + [total]
        rows.append((f"A{i}C", week, float(total), [0.0] * week + [float(x) for x in steps]))
    return spark.createDataFrame(rows, "m string, week int, total double, counts array<double>")


def test_band_pairs_meet_by_week_and_decade(spark):
    """Only single counts go through the join, the tables of sizes are broadcast, and nothing is crossed."""
    text = plan(pairs.week_band_pairs(made_series(spark, 60), 29))
    joins = re.findall(r"(?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) \[([^]]*)\]", text)
    assert len(joins) == 3 and "CartesianProduct" not in text and "NestedLoop" not in text and "array<double>" not in text
    assert any(all(k in keys for k in ("w1", "o#", "band", "_a", "_b")) for keys in joins)


@pytest.mark.parametrize("task_rows", [20_000, 7])
def test_band_candidates_are_few(spark, monkeypatch, task_rows):
    made, real = [], pairs.band_candidates

    def counted(leaders, partners):
        made.append(real(leaders, partners, task_rows).cache())
        return made[-1]

    monkeypatch.setattr(pairs, "band_candidates", counted)
    series = made_series(spark, 700).cache()
    got = {(r.seq0, r.seq1): (r.count0, r.count1, r.period) for r in pairs.week_band_pairs(series, 29).collect()}
    want, rows = {}, series.collect()
    for x in rows:
        for y in rows:
            gap, later = abs(x.week - y.week), max(x.week, y.week)
            c0, c1 = x.counts[29 - max(y.week - x.week, 0)], y.counts[29 - max(x.week - y.week, 0)]
            fit = lambda r: next((t for lo, hi, t in pairs.BRACKETS if lo <= r < hi), -1)
            if x.total >= 10 and gap <= fit(1 / x.total) and 30 - later >= max(8, 2 * gap) and c1 <= c0 and fit(c1 / c0) >= gap:
                want[x.m, y.m] = (c0, c1, 30 - later)
    assert got == want and len(want) > 10_000
    assert made[0].count() <= 3 * len(want)


def proteins(spark, n, runs, width, seed=1):
    """Sequences of one length: two changes each, and runs of X."""
    rng = random.Random(seed)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    reference, rows = random.Random(0).choices(letters, k=1273), []
    for _ in range(n):
        x = list(reference)
        for _ in range(2):
            x[rng.randrange(1273)] = rng.choice(letters)
        for _ in range(runs):
            at = rng.randrange(1273 - width)
            x[at : at + width] = "X" * width
        rows.append(("".join(x),))
    return spark.createDataFrame(rows, "seq string").repartition(4)


def test_wildcard_pairs_of_one_length(spark, monkeypatch):
    """All sequences share most of their blocks, yet few meet that aren't compatible."""
    met = []
    monkeypatch.setattr(wildcards, "stored", lambda df, name: met.append(out := stored(df, name)) or out if name == "met" else stored(df, name))
    found = {}
    for n in (500, 2000):
        met.clear()
        found[n] = wildcards.compatible_pairs(proteins(spark, n, 3, 60), proteins(spark, n, 0, 0, seed=2)).count()
        assert 0 < found[n] and met[0].count() <= 3 * found[n]


def test_sequences_alike_are_not_multiplied(spark, monkeypatch):
    """Thousands of sequences that differ by X alone: each finds a partner, no pair of them is made."""
    rng = random.Random(6)
    base = "ACDEFGHIKLMNPQRSTVWY" * 10
    masked = lambda: "".join("X" if rng.random() < 0.05 else c for c in base)
    a, b = ({masked() for _ in range(1500)} for _ in range(2))
    table = lambda x: spark.createDataFrame([(s,) for s in x], "seq string")
    pairs_, one, two = wildcards.compare(table(a), table(b))
    assert pairs_.count() == 0 and one.count() == len(a) and two.count() == len(b)
    got = {r.seq: r.matched for r in matching.match_known(table(a), table(b)).collect()}
    assert got == {s: s if s in b else min(b) for s in a}
    ranked = spark.createDataFrame([("r", s, i) for i, s in enumerate(sorted(a))] + [("q", s, -i) for i, s in enumerate(sorted(a))], "run string, seq string, rank int")
    assert sorted((r.run, r["rank"]) for r in matching.uniquify(ranked).collect()) == [("q", 1 - len(a)), ("r", 0)]


def test_nearest_ancestors_without_all_of_them(spark, monkeypatch):
    """Long chains of ancestors: only those at the least distance are made."""
    rng = random.Random(8)
    made, real = [], matching._contained
    monkeypatch.setattr(matching, "_contained", lambda *a: made.append(out := stored(real(*a), "contained")) or out)
    keys = set()
    for _ in range(40):
        units = [f"A{i}C" for i in sorted(rng.sample(range(1, 500), 30))]
        keys |= {",".join(units[:k]) for k in range(1, 31)}
    rows = sorted(keys)
    df = spark.createDataFrame([(m,) for m in rows], "m string")
    got = {r.m: (r.closest, r.distance) for r in matching.closest_ancestor(df, df.where("crc32(m) % 3 = 0")).collect()}
    assert set(got) == keys and all(v[0] is not None for v in got.values())
    split = {m: m.split(",") for m in rows}
    inside = lambda x, y: set(x) <= set(y) and all(u in it for it in [iter(y)] for u in x)
    old = [o for o in rows if zlib.crc32(o.encode()) % 3 == 0]
    for m, (closest, distance) in got.items():
        held = [(abs(d), d, o) for o in old for d in [len(split[m]) - len(split[o])] if inside(split[o], split[m]) or inside(split[m], split[o])]
        assert (abs(distance), distance, closest) == min(held)
    assert sum(t.count() for t in made) <= 3 * len(keys)


def test_kmers_of_a_long_sequence(spark):
    import time

    long = spark.createDataFrame([("r", "ACDEFGHIKL" * 8000)], "id string, seq string")
    evaluate.kmers(long, 11, "id").count()
    began = time.time()
    assert evaluate.kmers(long, 11, "id").count() == 80_000 - 10
    assert time.time() - began < 5


def test_stored_kmers_are_not_shuffled(spark, tmp_path):
    """A run with the index shuffles neither its k-mers nor those of samples whose bit isn't set."""
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("ACDE", k=n))
    known = [text(rng.randint(3, 60)) for _ in range(40)] + [None]
    samples = [text(rng.randint(0, 700)) for _ in range(25)] + [k + text(4) for k in known[:10]] + [None, "AC" * 500]
    table = lambda x: spark.createDataFrame([(s,) for s in x], "seq string")
    index = kmer_index.write_kmer_index(table(known), "known_kmers", f"file://{tmp_path}/index", k=6)
    seen = {k[i : i + 6] for k in filter(None, known) for i in range(len(k) - 5)}
    for s in (samples, samples[:3]):
        made = kmer_index.indexed_novelty(table(s), index)
        assert {r.seq: r.novelty for r in made.collect()} == {x: sum(x[i : i + 6] not in seen for i in range(len(x) - 5)) for x in s if x is not None}
    text = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    side = text[text.rindex("Sort [kmer") :]  # the known side of the join
    assert "SortMergeJoin [kmer" in text and "Bucketed: true" in side and "Exchange" not in side
    assert not kmer_index.indexed_novelty(table([]), index).count()
