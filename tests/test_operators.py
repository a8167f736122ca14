"""Golden values of pairs, splits and evaluation on tiny tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from seqtrend.functions import mutations
from seqtrend.operators import audit, evaluate, matching, pairs, ranks, series, splits


def obs(spark, rows):
    """rows: (m, day of January 2021[, lineage[, location]])."""
    full = [(str(i), *(list(r) + ["A", "Europe"][len(r) - 2 :])) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "acc string, m string, day int, lineage string, location string")
    return df.withColumn("d", F.date_add(F.lit("2020-12-31").cast("date"), F.col("day"))).drop("day")


J2_ROWS = [("A2B", 1), ("C3A", 3), ("C3A", 3), ("G4del", 5), ("T5A", 5), ("G4del", 7), ("C3A", 8), ("G4del", 9), ("A2B", 10), ("X1Z", 9), ("X1Z", 9), ("X1F", 10), ("X1F", 20), ("A2B", 25)]


def test_pairs_of_the_small_example(spark):
    rows = series.with_week(series.date_window(obs(spark, J2_ROWS), end="2021-01-10"), period=1)
    table = series.variant_series(rows, 9)
    assert {(r.m, r.week, r.total) for r in table.collect()} == {("A2B", 0, 2), ("C3A", 2, 3), ("G4del", 4, 3), ("T5A", 4, 1), ("X1Z", 8, 2), ("X1F", 9, 1)}
    split = ranks.apply_precomputed_split(table, *[spark.createDataFrame([(m,) for m in ms], "m string") for ms in (["C3A", "A2B", "T5A"], [], [])])
    made = pairs.week_band_pairs(split, 9, brackets=((0.0, 0.6, 5), (0.6, 1.0, 0)), min_lead=0, min_total=0)
    assert {(r.seq0, r.count0, r.seq1, r.count1, r.period) for r in made.collect()} == {("C3A", 3, "A2B", 1, 8), ("C3A", 3, "T5A", 1, 6)}


def brute_pairs(rows, last, brackets=pairs.BRACKETS, min_lead=8, min_total=10):
    tol = lambda x: next((t for a, b, t in brackets if a <= x < b), None)
    out = set()
    for (s, ws, cs), (p, wp, cp) in itertools.product(rows, rows):
        if cs[-1] < min_total or tol(1 / cs[-1]) is None or abs(wp - ws) > tol(1 / cs[-1]):
            continue
        period = min(last - ws + 1, last - wp + 1)
        n, k = cs[ws + period - 1], cp[wp + period - 1]
        if k > n or tol(k / n) is None or tol(k / n) < abs(wp - ws):
            continue
        lead = max(2 * abs(wp - ws), min_lead)
        if last - ws + 1 < lead or last - wp + 1 < lead:
            continue
        out.add((s, n, p, k, period))
    return out


def test_pairs_against_loops(spark):
    import random

    rng = random.Random(0)
    rows = []
    for i in range(60):
        week = rng.randint(0, 20)
        counts, total = [], 0.0
        for w in range(26):
            total += rng.choice([0, 0, 1, 5, 2000]) if w >= week else 0
            total += 1 if w == week else 0
            counts.append(total)
        rows.append((f"m{i}", week, counts))
    df = spark.createDataFrame([(m, w, c[-1], c) for m, w, c in rows], "m string, week int, total double, counts array<double>")
    made = pairs.week_band_pairs(df, 25, with_weekly=True).collect()
    assert {(r.seq0, r.count0, r.seq1, r.count1, r.period) for r in made} == brute_pairs(rows, 25) and made
    assert all(len(r.weekly_counts0) == 26 - next(w for m, w, _ in rows if m == r.seq0) for r in made)
    capped = pairs.week_band_pairs(df, 25, cap=4).collect()
    assert {(r.seq0, r.seq1) for r in capped} <= {(r.seq0, r.seq1) for r in made} and max(sum(r.seq0 == x.seq0 for r in capped) for x in capped) <= 4
    assert {(r.seq0, r.seq1) for r in pairs.week_band_pairs(df, 25, cap=1000).collect()} == {(r.seq0, r.seq1) for r in made}


A18 = {"A2B": (1400, 100), "C3A": (500, 500), "G4del": (250, 250), "T5A": (125, 125), "X1Z": (63, 62), "X1F": (31, 32)}


def one_day(spark, counts):
    return spark.createDataFrame([(m, 0, float(n), [float(n)]) for m, n in counts.items()], "m string, week int, total double, counts array<double>")


@pytest.mark.parametrize("given, change, how, want", [
    ([["A2B", "T5A"], ["C3A", "X1Z"], ["G4del", "X1F"]], {}, "intersection", {"train": [], "val": [("C3A", 1000, "X1Z", 125, 1)], "test": [("G4del", 500, "X1F", 63, 1)]}),
    ([["C3A", "X1Z"], ["A2B", "T5A"], ["G4del", "X1F"]], {}, "intersection", {"train": [("C3A", 1000, "X1Z", 125, 1)], "val": [], "test": [("G4del", 500, "X1F", 63, 1)]}),
    ([["A2B", "T5A"], ["C3A", "X1Z"], ["G4del", "X1F"]], {"X1F": (2, 0)}, "union", {"train": [], "val": [("C3A", 1000, "X1Z", 125, 1)], "test": [("G4del", 500, "X1F", 2, 1)]}),
])
def test_region_agreement(spark, given, change, how, want):
    counts = A18 | change
    a, b = (one_day(spark, {m: c[i] for m, c in counts.items() if c[i]}) for i in (0, 1))
    both = pairs.combine_regions(a, b, how)
    zero = one_day(spark, {m: 0 for m in counts})
    fill = lambda t: t.unionByName(zero.join(t.select("m"), "m", "left_anti").select(*t.columns))
    lists = [spark.createDataFrame([(m,) for m in x], "m string") for x in given]
    split = ranks.apply_precomputed_split(both, *lists)
    for name in ("train", "val", "test"):
        made = pairs.week_band_pairs(split.where(F.col("split") == name), 0, min_lead=0)
        kept = pairs.validate_pairs(made, fill(a), fill(b), p_value=0.1)
        assert [(r.seq0, r.count0, r.seq1, r.count1, r.period) for r in kept.collect()] == want[name], name
    with pytest.raises(ValueError):
        pairs.validate_pairs(split, a, b)


def test_combine(spark):
    a = spark.createDataFrame([("A2B", 1, 1.0, [0.0, 1.0, 1.0])], "m string, week int, total double, counts array<double>")
    assert pairs.combine_regions(a, a.limit(0)).count() == 0
    assert pairs.combine_regions(a, a.limit(0), "union").collect() == pairs.combine_regions(a.limit(0), a, "union").collect()
    assert pairs.combine_regions(a, a.limit(0), "union").first().counts == [0.0, 1.0, 1.0]


def test_frequent_rare(spark):
    lists = spark.createDataFrame([("A2B", 1500, "frequent"), ("F1", 900, "frequent"), ("F2", 800, "frequent"), ("F3", 700, "frequent"), ("X1Z", 3, "rare"), ("R1", 2, "rare"), ("R2", 1, "rare"), ("R3", 1, "rare")], "m string, n long, kind string")
    prior = spark.createDataFrame([("A2B", 1500.0, "X1Z", 1.0, 100, "train")], "seq0 string, count0 double, seq1 string, count1 double, period int, split string")
    rows = pairs.frequent_rare_pairs(lists, prior, 1, 1, 1).collect()
    by = {s: {(r.seq0, r.seq1) for r in rows if r.split == s} for s in ("train", "val", "test")}
    assert len(by["train"]) == 4 and len(by["val"]) == len(by["test"]) == 1 and ("A2B", "X1Z") in by["train"]
    old = next(r for r in rows if (r.seq0, r.seq1) == ("A2B", "X1Z"))
    assert (old.count0, old.count1, old.period) == (1500, 3, None)


def test_frequent_and_rare(spark):
    rows = series.with_week(obs(spark, [("A", 1)] * 5 + [("B", 2)] * 2 + [("C", 30)]))
    assert {(r.m, r.kind) for r in series.frequent_and_rare(rows, 1, 5, 2).collect()} == {("A", "frequent"), ("B", "rare")}


def test_synthetic_negatives(spark):
    known = obs(spark, [("F6B,A1024G", 1), ("E5A", 1), ("A2B", 1), ("C3D,D4E", 1), ("F6Z", 1)])
    made = pairs.synthetic_negatives(spark.createDataFrame([("F6B,A1024G", "E5A")], "seq0 string, seq1 string"), known, 2, 30, seed=1).collect()
    assert made and all(r.count0 == 1 and r.count1 == 0 for r in made)
    for r in made:
        places = [p for _, p, _ in mutations.parse(r.seq1)]
        assert places == sorted(places) and len(places) == len(mutations.parse(r.seq0)) + 2
        assert set(r.seq0.split(",")) < set(r.seq1.split(","))


def test_same_week_shares(spark):
    rows = series.with_week(obs(spark, [("A2B", 1), ("C3A", 3), ("C3A", 4), ("G4del", 5), ("T5A", 5), ("G4del", 6)]), period=2)
    got = {(r.seq0, r.seq1): round(r.label, 6) for r in pairs.same_week_pairs(rows).collect()}
    assert got == {("G4del", "T5A"): round(1 / 3, 6), ("T5A", "G4del"): round(2 / 3, 6)}


W3 = [("A2B", 1, "A"), ("C3A", 3, "B"), ("C3A", 3, "B"), ("G4del", 5, "C"), ("T5A", 5, "D"), ("G4del", 7, "C"), ("C3A", 8, "B"), ("G4del", 9, "C"), ("A2B", 10, "A"), ("X1Z", 9, "E"), ("X1Z", 9, "E"), ("X1P", 9, "E"), ("X1F", 10, "F")]


def test_lineage_split(spark):
    rows = series.date_window(obs(spark, W3), end="2021-01-09")
    made = splits.split_by_lineage(rows, 1, 1, 1).collect()
    by = {s: {r.lineage for r in made if r.split == s} for s in ("train", "val", "test")}
    assert {m: n for m, n in ((r.m, r.n) for r in made)} == {"A2B": 1, "C3A": 3, "G4del": 3, "T5A": 1, "X1Z": 2, "X1P": 1}
    for block in ({"E", "C", "B"}, {"D", "A"}):  # ranked by (count, name), both descending
        assert all(len(by[s] & block) <= 1 for s in by) and len(by["train"] & block) == 1
    assert splits.enumerate_rows(splits.split_by_lineage(rows, 1, 1, 1)).count() == 11


def test_date_split(spark):
    rows = obs(spark, [("N5Y", 15), ("N5Y,D6G", 16), ("N5Y", 16)])
    made = {(r.m, r.split) for r in splits.date_split(rows, "2021-01-15", "2021-01-16").collect()}
    assert made == {("N5Y", "train"), ("N5Y,D6G", "val")}


def test_hash_split(spark):
    df = spark.createDataFrame([(x, x) for x in ("abc", "xyz", "a", "b", "c", "d")], "id string, cluster string")
    buckets = {r.id: r.b for r in df.select("id", splits.cluster_bucket("cluster").alias("b")).collect()}
    assert buckets == {"abc": 1821, "xyz": 8994, "a": 8987, "b": 781, "c": 8614, "d": 9732}
    made = {r.id: r.split for r in splits.hash_cluster_split(df, df.where("id <> 'd'"), [1, 1], ["1", "2"]).collect()}
    assert made == {"abc": "1", "xyz": "2", "a": "2", "b": "1", "c": "2"}


def test_splits_are_whole_and_stable(spark):
    df = spark.createDataFrame([(f"m{i}", i % 7) for i in range(200)], "m string, total long")
    made = [sorted(map(tuple, ranks.split_by_rank_blocks(df.repartition(n), 3, 1, 1, seed=2).collect())) for n in (1, 7, 20)]
    assert made[0] == made[1] == made[2] and len(made[0]) == 200
    sizes = {s: sum(r[2] == s for r in made[0]) for s in ("train", "val", "test")}
    assert sizes == {"train": 120, "val": 40, "test": 40}
    two = ranks.split_by_rank_blocks(df, 4, 1, 0, seed=2)
    assert two.where("split = 'val'").count() == 40
    with pytest.raises(ValueError):
        ranks.split_by_rank_blocks(df, 4, 0, 0, seed=2)


def test_stratified(spark):
    df = spark.createDataFrame([(i, "abc"[min(i // 10, 2)]) for i in range(60)], "id long, s string")
    got = [r.s for r in ranks.stratified_sample(df, "s", 24, 1, ["id"]).collect()]
    assert sorted(got.count(x) for x in "abc") == [8, 8, 8]
    assert len(ranks.stratified_sample(df, "s", 60, 1, ["id"]).collect()) == 30
    assert ranks.stratified_sample(df.where("s = 'a'"), "s", 5, 1, ["id"]).count() == 5


def plain_compatible(a, b):
    means = mutations.AMBIGUOUS
    return len(a) == len(b) and all(x == y or "X" in (x, y) or y in means.get(x, "") or x in means.get(y, "") for x, y in zip(a, b))


def test_matching(spark):
    import random

    rng = random.Random(2)
    seqs = ["".join(rng.choices("ADNIL", k=rng.randint(1, 10))) for _ in range(60)]
    for s in list(seqs):
        seqs += ["".join(rng.choice([c, c, "X", {"D": "B", "N": "B", "I": "J", "L": "J"}.get(c, "X")]) for c in s) for _ in range(2)]
    half = len(seqs) // 2
    a, b = set(seqs[:half]), set(seqs[half:])
    table = lambda x: spark.createDataFrame([(s,) for s in x], "seq string")
    got = {(r.a, r.b) for r in matching.compatible_pairs(table(a), table(b)).collect()}
    assert got == {(x, y) for x in a for y in b if x != y and plain_compatible(x, y)}
    found = {r.seq: (r.matched, r.exact) for r in matching.match_known(table(a), table(b)).collect()}
    for x in a:
        close = sorted(y for y in b if plain_compatible(x, y))
        assert found[x] == ((x, True) if x in b else (close[0] if close else None, False))
    ranked = spark.createDataFrame([("r", s, i) for i, s in enumerate(seqs)], "run string, seq string, rank int")
    kept = [i for i, s in enumerate(seqs) if not any(plain_compatible(s, t) for t in seqs[:i])]
    once = matching.uniquify(ranked)
    assert sorted(r["rank"] for r in once.collect()) == kept
    assert matching.uniquify(once).count() == len(kept)
    assert matching.uniquify(ranked, ambiguous=False).count() == len(set(seqs))


def test_closest_ancestor(spark):
    import random

    rng = random.Random(5)
    pool = [f"A{i}C" for i in range(1, 9)]
    key = lambda k: ",".join(sorted(rng.sample(pool, k), key=lambda t: int(t[1:-1])))
    old, new = {key(rng.randint(0, 4)) for _ in range(25)} | {""}, {key(rng.randint(0, 6)) for _ in range(25)} | {""}
    for known in (old, old - {""}):
        want = {}
        for m in new:
            us, best = m.split(",") if m else [], None
            for o in known:
                uo = o.split(",") if o else []
                for small, large, sign in ((uo, us, 1), (us, uo, -1)):
                    it = iter(large)
                    if all(u in it for u in small):
                        d = sign * (len(large) - len(small))
                        best = min(filter(None, [best, (abs(d), d, o)]))
            want[m] = (best[2], best[1]) if best else (None, None)
        got = {r.m: (r.closest, r.distance) for r in matching.closest_ancestor(spark.createDataFrame([(m,) for m in new], "m string"), spark.createDataFrame([(m,) for m in known], "m string")).collect()}
        assert got == want


def test_membership(spark):
    prior = spark.createDataFrame([([1, 2],), ([3],), ([4, 5],)], "input_ids array<int>")
    rows = matching.membership(prior, spark.createDataFrame([(0, [1, 2]), (1, [2, 1]), (2, [3]), (3, [4])], "i int, input_ids array<int>")).orderBy("i").collect()
    assert [r.known for r in rows] == [True, False, True, False]


def test_quantiles(spark):
    bounds = spark.createDataFrame([(0, -1e5, 0.0), (1, 0.0, 0.25), (2, 0.25, 0.5), (3, 0.5, 1.5), (4, 1.5, 1e5)], "q int, low double, high double")
    rows = evaluate.assign_quantile(spark.createDataFrame([(1.5, True), (0.5, False), (0.25, False)], "score double, known boolean"), bounds)
    assert sorted(30 + r.quantile for r in rows.collect()) == [32, 33, 35]
    scores = spark.createDataFrame([(float(i),) for i in range(1, 11)], "score double")
    got = {(r.q, r.low, r.high) for r in evaluate.quantile_bounds(scores, [0.1, 0.5]).collect()}
    assert got == {(2, 10.0, float("inf")), (1, 6.0, 10.0), (0, float("-inf"), 6.0)}


def test_novelty_of_known_is_zero(spark):
    known = spark.createDataFrame([("ABCDEFGHIJKLMN*",)], "seq string")
    rows = evaluate.kmer_novelty(known.union(spark.createDataFrame([("ABCDEFGHIJKZMN*",), ("AB",)], "seq string")), known, 11)
    assert {r.seq: r.novelty for r in rows.collect()} == {"ABCDEFGHIJKLMN*": 0, "ABCDEFGHIJKZMN*": 4, "AB": 0}


def test_classified_samples(spark):
    known = obs(spark, [("A1C", 1, "L1"), ("A1C", 9, "L2"), ("D2E", 9, "L2"), ("D2E", 10, "L3")])
    known = known.withColumn("seq", F.when(F.col("m") == "A1C", "CDEFGHIKLMN*").otherwise("AEEFGHIKLMN*"))
    rows = spark.createDataFrame([("r", "CDEFGHIKLMN*", 1.0), ("r", "AEEFGHIKLMN*", 2.0), ("r", "AEXFGHIKLMN*", 3.0), ("r", "WWW*", 4.0), ("r", "W[X]*", 5.0)], "run string, seq string, score double")
    got = {r.score: r for r in evaluate.classify_samples(rows, known, "2021-01-05").collect()}
    flags = lambda r: (r.old_seq, r.new_seq, r.false_seq, r.invalid_seq)
    assert [flags(got[s]).index(True) for s in (1.0, 2.0, 3.0, 4.0, 5.0)] == [0, 1, 1, 2, 3] and all(sum(flags(r)) == 1 for r in got.values())
    assert got[2.0]["count"] == 2 and got[3.0]["count"] == 0 and got[1.0].novelty == 0 and got[2.0].lineage == ["L2", "L3"]
    assert not got[1.0].new_lineage and got[2.0].new_lineage


def test_mean_ci(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 4.0), ("c", 4.0)], "t string, v double")
    got = {r.t: r for r in evaluate.mean_ci(df, ["t"], "v").collect()}
    assert got["a"].mean == 2 and abs(got["a"].err - 12.706204736) < 1e-6 and got["b"].err is None and got["c"].err == 0
    curves = spark.createDataFrame([("a", "r1", 1, 1.0), ("a", "r1", 2, 3.0), ("a", "r2", 1, 3.0)], "t string, run string, place int, v double")
    assert {(r.place, r.mean) for r in evaluate.mean_ci_by_place(curves, ["t"], "v").collect()} == {(1, 2.0)}


def test_audit(spark):
    joined = spark.createDataFrame([("v1|x", "A"), ("v2|x", "B"), ("v3", None), ("v4", "C")], "virus_name string, lineage string")
    reports = spark.createDataFrame([("v1", "A"), ("v2", "C"), ("v3", "A")], "taxon string, lineage string")
    assert tuple(audit.reassignment_audit(joined, reports).first()) == (4, 1, 3, 1)
    df = spark.createDataFrame([("(Spike_D2G,Spike_A1C)", "2", "2021-01-02"), ("Spike_A1C,Spike_D2G", "1", "2021-01-02"), (None, "3", "2020-01-01")], "aa string, acc string, d string")
    assert [tuple(r) for r in audit.minimal_sequences(df).collect()] == [("Spike_A1C,Spike_D2G", "1", "2021-01-02")]


def test_reconstruction(spark):
    rows = spark.createDataFrame([("1", "A1C"), ("2", "A1C"), ("3", ""), ("4", "")], "acc string, m string")
    fa = spark.createDataFrame([("h|EPI_ISL_1|x", "CCD*"), ("h|EPI_ISL_2|x", "ACD*"), ("h|EPI_ISL_3|x", "XCB*"), ("h|none", "ACD*")], "header string, sequence string")
    got = {r.acc: r.reconstructed for r in audit.label_reconstruction(rows, fa, "ACD*").collect()}
    assert got == {"1": True, "2": False, "3": True, "4": False}
    assert audit.label_reconstruction(rows, fa, "ACD*", fake=True).where("reconstructed").count() == 4


def test_merge_and_prior_errors(spark):
    df = spark.createDataFrame([("t", f"r{i}") for i in range(5)], "tool string, run string")
    with pytest.raises(Exception, match="can't be merged"):
        evaluate.merge_runs(df, "tool", 2).collect()
    gens = spark.createDataFrame([("p", 1, 0.5)], "parent string, generation int, metric double")
    with pytest.raises(Exception, match="no share"):
        evaluate.add_prior(gens, spark.createDataFrame([("q", 0.5)], "seq string, share double")).collect()
