import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqtrend.functions import dates, mutations, stats, tokens
from seqtrend.functions.rand import rand_key, rand_share


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_rand_key_is_pure(spark):
    import hashlib

    df = spark.createDataFrame([("a", 1), ("b", 2)], "a string, b long")
    keys = {r.a: r.k for r in df.select("a", rand_key(3, "a", "b").alias("k")).collect()}
    assert keys["a"] == int(hashlib.sha256(b"3|a|1").hexdigest()[:15], 16)
    assert all(0 <= r.s < 1 for r in df.select(rand_share(3, "a").alias("s")).collect())


@pytest.mark.parametrize("text, want", [("2021-03-04", "2021-03-04"), ("2021-3-4", "2021-03-04"), ("2021-03", "2021-03-01"), ("2021", "2021-01-01"), ("x", None), ("2021-99-01", None), ("", None), ("2021-03-04T10:00", "2021-03-04")])
def test_parse_date(spark, text, want):
    got = one(spark, dates.parse_date("t"), t=text)
    assert (str(got) if got else None) == want


def test_weeks(spark):
    df = spark.createDataFrame([("2021-01-01", 0, 0), ("2021-01-02", 0, 1), ("2021-01-08", 1, 1), ("2021-01-09", 1, 2)], "d string, w int, a int")
    start = F.lit("2021-01-01").cast("date")
    rows = df.select("w", "a", dates.week_index(F.col("d").cast("date"), start).alias("x"), dates.week_after(F.col("d").cast("date"), start).alias("y")).collect()
    assert all((r.w, r.a) == (r.x, r.y) for r in rows)


def test_apply_mutations():
    assert mutations.mutated("G3del,A4del,T6G,ins7XX", "ACGACTZBADAC") == "ACCGZXXBADAC"
    assert mutations.mutated("ins1A,N5del,D6del,A7del", "ABCDNDAC") == "AABCDC"
    assert mutations.mutated("", "ABC") == "ABC" and mutations.mutated("ins0X", "ABC") == "XABC"
    for bad in ("A9C", "A0C", "5", "ins4A"):
        with pytest.raises(ValueError):
            mutations.mutated(bad, "ABC")


def test_extract_and_apply(spark):
    df = spark.createDataFrame([("Spike_D6G,Spike_N5Y",), ("Spike_N5del,Spike_D6del,Spike_A7del,Spike_ins1A",), ("(NSP1_A1C,N_X-)",), (None,)], "aa string")
    rows = mutations.apply_mutations(df.withColumn("m", mutations.extract_mutations("aa")), "ABCDNDAC").collect()
    assert {(r.m, r.seq) for r in rows} == {("N5Y,D6G", "ABCDYGAC"), ("ins1A,N5del,D6del,A7del", "AABCDC"), ("", "ABCDNDAC")}
    assert len(rows) == 4


def test_canonical(spark):
    assert one(spark, mutations.canonical_mutations("t"), t="(Spike_N5Y, N_A3C,bad,Spike_D2G)") == "bad,N_A3C,Spike_D2G,Spike_N5Y"


def test_changed_spans(spark):
    want = [(0, 2), (1, 5), (5, 6), (5, 7), (6, 9)]
    assert mutations.spans("Y2del,B3del,ins4AB,T6G,G7del,ins8A") == want
    df = mutations.changed_spans(spark.createDataFrame([("Y2del,B3del,ins4AB,T6G,G7del,ins8A",), ("",)], "m string"))
    assert {tuple((s.start, s.end) for s in r.spans) for r in df.collect()} == {tuple(want), ()}


def test_units(spark):
    for m, want in (("", []), ("A1C,G2del,T3del,ins3A,C5del", ["A1C", "G2del,T3del", "ins3A", "C5del"]), ("A1del,A2del,A3del", ["A1del,A2del,A3del"])):
        assert one(spark, mutations.mutation_units("m"), m=m) == want == mutations.units_of(m)


def test_valid_samples(spark):
    df = spark.createDataFrame([("ACD*", True), ("ACD", False), ("A*C*", False), ("A[MASK]*", False), ("A<x>*", False), (None, False)], "s string, ok boolean")
    assert all(r.ok == r.x for r in df.select("ok", mutations.is_valid_sample("s").alias("x")).collect())


def test_ambiguity(spark):
    rows = [("ABC", "ADC", True, True), ("ADC", "ABC", False, True), ("XJZ", "ALQ", True, True), ("ALQ", "XJZ", False, True), ("AB", "AC", False, False), ("A", "AA", False, False), ("", "", True, True)]
    df = spark.createDataFrame(rows, "a string, b string, v boolean, c boolean")
    assert all((r.v, r.c) == (r.x, r.y) for r in df.select("v", "c", mutations.verify_sequence("a", "b").alias("x"), mutations.compatible("a", "b").alias("y")).collect())


def plain_gotoh(a, b):
    low = -1e18
    m, d, i = (np.full((len(a) + 1, len(b) + 1), low) for _ in range(3))
    m[0, 0] = 0
    for x in range(len(a) + 1):
        for y in range(len(b) + 1):
            if x and y:
                m[x, y] = max(t[x - 1, y - 1] for t in (m, d, i)) + (1 if a[x - 1] == b[y - 1] else -1)
            if x:
                d[x, y] = max(max(m[x - 1, y], i[x - 1, y]) - 4, d[x - 1, y] - 0.1)
            if y:
                i[x, y] = max(max(m[x, y - 1], d[x, y - 1]) - 4, i[x, y - 1] - 0.1)
    return max(t[-1, -1] for t in (m, d, i))


def test_alignment_score_and_round_trip(spark):
    import random

    rng = random.Random(1)
    ref = "".join(rng.choices("ACDEFGHIK", k=40))
    seqs = [ref, ref[:10] + ref[14:], ref[:20] + "WWW" + ref[20:], "W" + ref, ref + "W", ref[5:] + "VV"]
    seqs += ["".join(rng.choices("ACDEFGHIK", k=rng.randint(1, 45))) for _ in range(25)]
    for s in seqs:
        assert abs(mutations.global_alignment(ref, s)[0] - plain_gotoh(ref, s)) < 1e-9
        for merge in (True, False):
            m = mutations.aligned(ref, s, merge)
            if merge:
                assert mutations.mutated(m, ref) == s
    df = mutations.align_mutations(spark.createDataFrame([(s,) for s in seqs], "seq string"), ref)
    assert all(mutations.mutated(r.m, ref) == r.seq for r in df.collect())
    assert mutations.aligned(ref, ref[:10] + ref[11:]).endswith("del") and mutations.aligned("ACD", "ACWWD") == "ins2WW"


def test_long_alignments_stay_small(monkeypatch):
    import random
    import tracemalloc

    rng = random.Random(4)
    ref = "".join(rng.choices("ACDEFGHIK", k=120))
    for k in range(12):
        s = "".join(c if rng.random() < 0.8 else rng.choice(["", "W", c + "V"]) for c in ref)
        whole = mutations._gotoh(ref, s, 150)
        with monkeypatch.context() as m:
            m.setattr(mutations, "CELLS", 600)  # stretches of a few rows
            assert mutations._gotoh(ref, s, 150) == whole
        assert whole[0] / 10 == pytest.approx(plain_gotoh(ref, s))
    long = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=30_000))
    changed = "W" * 7 + long[5:9000] + long[9040:20_000] + "VWV" * 10 + long[20_000:]
    tracemalloc.start()
    score, steps = mutations.global_alignment(long, changed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(steps) - steps.count("I") == len(long) and len(steps) - steps.count("D") == len(changed)
    assert score > 30_000 - 45 - 40


def test_edit_distance(spark):
    rows = [("", "A1C", 1, 1), ("A1C", "", 1, None), ("A1C,G3T", "A1C,C2G,G3T", 1, 1), ("A1C,G3T", "G3T,A1C", 2, None), ("A1C", "A1C", 0, 0), ("A1del,C2del", "A1del", 2, None)]
    df = spark.createDataFrame(rows, "a string, b string, full int, ins int")
    both = mutations.edit_distance(mutations.edit_distance(df, "a", "b", "x"), "a", "b", "y", insert_only=True)
    assert all((r.full, r.ins) == (r.x, r.y) for r in both.collect())


def test_encode_and_crop(spark):
    assert one(spark, tokens.encode("s"), s="ACO*") == [26, 0, 1, 25, 27]
    for bad in ("AC", "A1*"):
        with pytest.raises(Exception):
            one(spark, tokens.encode("s"), s=bad)
    df = spark.createDataFrame([("ABCDEFG",), ("DEFG",), ("XYZABCACACXAG",)], "s string")
    got = {r.s: r.x for r in df.select("s", tokens.pad_or_crop("s", 9, F.lit(2).cast("long")).alias("x")).collect()}
    ids = {c: i for i, c in enumerate(tokens.LETTERS)}
    assert got["XYZABCACACXAG"].input_ids == [26, *[ids[c] for c in "ZABCACAC"]]
    assert got["DEFG"].input_ids == [26, *[ids[c] for c in "DEFG"], 0, 0, 0, 0] and got["DEFG"].attention_mask == [1] * 5 + [0] * 4 and got["DEFG"].labels[5:] == [-100] * 4
    dropped = df.select(tokens.pad_or_crop("s", 9, F.lit(2).cast("long"), ignore_too_long=True).alias("x")).where("x is not null")
    assert dropped.count() == 2
    pool = one(spark, tokens.pool_form(F.array(*map(F.lit, [26, 1, 2, 27, 5])), 6, F.lit(30)))
    assert pool.input_ids == [26, 30, 1, 2, 27, 5] and pool.attention_mask == [1, 1, 1, 1, 1, 0]
    assert one(spark, tokens.pool_form(F.array(F.lit(26), F.lit(1)), 4)) is None


def test_chunks(spark):
    df = spark.createDataFrame([("ACGXXFNMBMNUACHUACPQRST*",), ("*",), ("",)], "seq string")
    assert [(r.fragment, r.piece) for r in tokens.chunk_sequence(df, 12).orderBy("fragment").collect()] == [(0, "ACGXXFNMBMNU"), (1, "ACHUACPQRST")]


def test_anchors(spark):
    s = "AABCDAIGHACGACGAABHGAIGH"
    assert one(spark, tokens.anchor_length("s", longest=16), s=s) == 4 and one(spark, tokens.anchor_length("s", suffix=True, longest=16), s=s) == 5
    assert one(spark, tokens.anchor_length("s", longest=3), s="AAAAAA") is None


def test_masked_examples(spark):
    x = one(spark, tokens.mask_at("s", F.lit(2), F.lit(3)), s="ABCDEFG")
    assert x.encoder == ["[CLS]", "A", "B", "[MASK]", "F", "G", "[SEP]"] and x.decoder == ["C", "D", "E", "[MASK]"]
    df = spark.createDataFrame([("ABCDEFGHIKLMNPQ" * (i % 3 + 1) + "WY"[i % 2],) for i in range(30)] + [("AA",)], "seq string")
    rows = tokens.masked_example(df, seed=1, longest=8).collect()
    assert rows and all(1 <= r.mask_length <= min(8, len(r.seq) // 2) for r in rows)
    for r in rows:
        assert "".join(r.example.encoder[1 : 1 + r.mask_start]) + "".join(r.example.decoder[:-1]) == r.seq[: r.mask_start + r.mask_length]
    assert rows == tokens.masked_example(df.repartition(7), seed=1, longest=8).collect() or sorted(map(str, rows)) == sorted(map(str, tokens.masked_example(df.repartition(7), seed=1, longest=8).collect()))


def plain_tiles(seq, seed, shortest, longest):
    """The fold in plain Python, and its draws of more tiles."""
    key = lambda *parts: int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)
    own, out, at, last = key(seed, seq), [], 0, -1
    while at < len(seq):
        low = max(shortest, 1) if last == 0 else shortest
        last = low + key(seed, own, len(out) + 1) % (longest - low + 1)
        out.append((at, last))
        at += last
    return out, [t for _, _, t in sorted((key(f"{seed}-extra", own, i), i, t) for i, t in enumerate(out))]


def test_tiles(spark):
    texts = ["A" * 100, "C", "ACD" * 70, "", "AC" * 300, None]
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    for seed, shortest, longest in ((1, 0, 9), (2, 0, 1), (3, 4, 4), (4, 0, 128)):
        got = {r.seq: [tuple(x) for x in r.t] if r.t is not None else None for r in df.select("seq", tokens.tiles("seq", seed, shortest, longest).alias("t")).collect()}
        assert got == {t: [] if t is None else plain_tiles(t, seed, shortest, longest)[0] for t in texts}
        for t in filter(None, texts):
            found = got[t]
            assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(found[-1]) >= len(t)
            assert not any(n == m == 0 for (_, n), (_, m) in zip(found, found[1:]))
    with pytest.raises(ValueError):
        tokens.tiles("seq", 1, 0, 0)


def test_selected_tiles(spark):
    rows = [("A" * 100, [(10, 12), (60, 61), (98, 140)]), ("C" * 50, []), ("D" * 30, [(-3, 1), (29, 29), (500, 600)]), ("E" * 40, None), ("", [(0, 1)])]
    df = spark.createDataFrame(rows, "seq string, spans array<struct<start:int,end:int>>")
    for least in (0, 2, 1000):
        got = {}
        for r in tokens.tile_masks(df, 3, 0, 9, spans="spans", least_extra=least).collect():
            got.setdefault(r.seq, []).append((r.mask_start, r.mask_length))
        for seq, spans in rows:
            every, drawn = plain_tiles(seq, 3, 0, 9)
            hit = [t for t in every if any(t[0] <= p < sum(t) for a, b in spans or [] for p in range(a, b))]
            assert sorted(got.get(seq, [])) == sorted(hit + drawn[: max(least, len(hit))])


@pytest.mark.parametrize("frozen, want", [([4, 5], ["ACG", "GB", "A", "AC"]), ([4, 6], ["ACG", "GB", "T", "C"])])
def test_sliding_stimuli(spark, frozen, want):
    rows = tokens.sliding_stimuli(spark.createDataFrame([("ACGBHTACT",)], "seq string"), 3, 2, frozen).orderBy("mask_start", "mask_length").collect()
    assert sorted(r.seq[r.mask_start : r.mask_start + r.mask_length] for r in rows) == sorted(want)


def test_clean_generated(spark):
    for style, text, want in (("end", "ACD*EF*", "ACD*"), ("end", "ACD", "ACD"), ("marker", "AC D**<|endoftext|>", "ACD*"), ("framed", "1ACD2", "ACD*"), ("framed", "ACD", None)):
        assert one(spark, tokens.clean_generated("t", style), t=text) == want


def test_small_columns(spark):
    assert one(spark, tokens.pad_leading_weeks(F.array(F.lit(1.0), F.lit(2.0)), 3)) == [1.0, 2.0, 0.0]
    assert [one(spark, tokens.discretise(F.lit(p), [(0, 0.5), (0.5, 1)])) for p in (0.2, 0.5, 1.0)] == [0, 1, 0]


def test_statistics():
    assert abs(stats.fisher_exact(8, 2, 1, 5) - 0.034965034965034975) < 1e-9
    assert stats.fisher_exact(0, 0, 3, 4) == 1.0
    assert abs(stats.chi2_yates(10, 20, 30, 40) - math.erfc(math.sqrt(0.4464285714285714 / 2))) < 1e-9
    for df, want in ((1, 12.706204736), (2, 4.302652730), (4, 2.776445105), (30, 2.042272456)):
        assert abs(stats.t_quantile(0.975, df) - want) < 1e-6
