"""Pairs of variants whose spread can be compared.

A series has (m, week, total, counts): first week, total and running counts of weeks 0 to last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrend.functions.mutations import position, tokens
from seqtrend.functions.rand import rand_key
from seqtrend.functions.stats import chi2_yates, fisher_exact
from seqtrend.operators.broadcasts import if_small
from seqtrend.operators.ranks import random_rank
from seqtrend.sources.scratch import stored

# Brackets [low, high) of the ratio of two counts with the weeks tolerated, lead times, least total.
BRACKETS = ((0.0, 1e-5, 5), (1e-5, 1e-4, 4), (1e-4, 1e-3, 3), (1e-3, 1e-2, 2), (1e-2, 1e-1, 1), (1e-1, 1.0, 0))
LEAD_RATIO, MIN_LEAD, MIN_TOTAL = 2, 8, 10
CHI2_LEAST = 5
#: Rows of one week and decade from which they are dealt to several tasks: up to a million pairs each.
TASK_ROWS = 1_000
#: Counts of all series of a table that is broadcast, at most: 64 MB.
SERIES_COUNTS = 8 << 20


def bracket(ratio: Column, brackets=BRACKETS) -> Column:
    """Weeks tolerated for a ratio of counts; null outside of all brackets, so for 1."""
    out = F.lit(None).cast("int")
    for low, high, weeks in brackets:
        out = F.when((ratio >= F.lit(float(low))) & (ratio < F.lit(float(high))), F.lit(weeks)).otherwise(out)
    return out


def _decade(count: Column) -> Column:
    """0 for counts below 1, else 1 and the power of ten: it grows with the count."""
    return F.when(count < 1, 0).otherwise(1 + F.floor(F.log10(count))).cast("int")


def band_candidates(leaders: DataFrame, partners: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Leaders with the partners of their week and offset whose count is in the decades of theirs, [low, high).

    Leaders have (seq0, w1, o, low, high), partners (seq1, w1, o, count1). Both are dealt by week, offset and
    decade; where a key has more than ``task_rows`` rows on a side, those are dealt to parts by a hash of the
    variant and meet all parts of the other side. The keys are weeks by offsets by decades, so their table is
    broadcast.
    """
    key = ["w1", "o", "band"]
    a = leaders.withColumn("band", F.explode(F.sequence(_decade(F.col("low")), _decade(F.col("high")))))
    b = partners.withColumn("band", _decade(F.col("count1")))
    sizes = a.groupBy(*key).agg((F.floor(F.count("*") / task_rows) + 1).alias("_na"))
    sizes = sizes.join(b.groupBy(*key).agg((F.floor(F.count("*") / task_rows) + 1).alias("_nb")), key)
    sizes = F.broadcast(stored(sizes, "sizes"))
    parts = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(sizes, key).withColumn("_a", F.pmod(F.xxhash64("seq0"), F.col("_na"))).withColumn("_b", parts("_nb")).drop("_na", "_nb")
    b = b.join(sizes, key).withColumn("_b", F.pmod(F.xxhash64("seq1"), F.col("_nb"))).withColumn("_a", parts("_na")).drop("_na", "_nb")
    # By number: the rows are few bytes but make many pairs, and an adaptive plan would give them to one task.
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (t.repartition(n, *key, "_a", "_b") for t in (a, b))
    return a.join(b, [*key, "_a", "_b"]).drop("band", "_a", "_b")


def _few(series: DataFrame) -> bool:
    """The series hold so few counts that they may be broadcast: pairs then stay where they are and carry no series along."""
    return series.agg(F.coalesce(F.sum(F.size("counts")), F.lit(0))).first()[0] <= SERIES_COUNTS


def week_band_pairs(
    series: DataFrame, last_week: int, cap: int | None = None, seed: int = 0, brackets=BRACKETS, min_lead: int = MIN_LEAD, min_total: int = MIN_TOTAL, with_weekly: bool = False
) -> DataFrame:
    """(seq0, count0, seq1, count1, period[, weekly_counts0, weekly_counts1]): leading and partner variant.

    A leading variant of ``min_total`` sightings is compared with those first seen within the weeks that its
    total tolerates; with ``cap`` only with that many of them, at random. Both are counted as many weeks after
    their first as the later one has: its total, and the earlier one's count at most the widest tolerance before
    the end. So only the last few counts matter. The weeks of a band are exploded, and with the week a leader
    knows its own count and the limits of its partner's: they meet by week and by the decade of that count.
    """
    widest = max(t for *_, t in brackets)
    total, tail = F.element_at("counts", -1), F.reverse(F.slice("counts", -(widest + 1), widest + 1))
    tail = F.when(F.size("counts") > widest, tail).otherwise(F.reverse("counts"))
    lead = series.where(total >= min_total).select(F.col("m").alias("seq0"), F.col("week").alias("w0"), tail.alias("c0"), bracket(1 / total, brackets).alias("_t"))
    lead = lead.where(F.col("_t").isNotNull() & (last_week - F.col("w0") + 1 >= min_lead))
    lead = lead.withColumn("w1", F.explode(F.sequence(F.greatest(F.lit(0), F.col("w0") - F.col("_t")), F.least(F.lit(last_week), F.col("w0") + F.col("_t")))))
    gap, later = F.abs(F.col("w1") - F.col("w0")), F.greatest("w0", "w1")
    lead = lead.withColumns({"gap": gap, "period": (last_week - later + 1).cast("int"), "count0": F.get("c0", F.greatest(F.col("w1") - F.col("w0"), F.lit(0))), "o": F.greatest(F.col("w0") - F.col("w1"), F.lit(0))})
    lead = lead.drop("c0", "_t")
    # What the brackets that tolerate a gap leave of the partner's count.
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for g in range(widest + 1):
        fit = [x for x in brackets if x[2] >= g]
        low, high = F.when(F.col("gap") == g, min(x[0] for x in fit)).otherwise(low), F.when(F.col("gap") == g, max(x[1] for x in fit)).otherwise(high)
    near = lead.withColumns({"low": low * F.col("count0"), "high": F.least(high, F.lit(1.0)) * F.col("count0")})
    near = near.where((F.col("period") >= LEAD_RATIO * F.col("gap")) & (F.col("count0") > 0))
    partner = series.select(F.col("m").alias("seq1"), F.col("week").alias("w1"), tail.alias("c1"))
    late = last_week - F.col("w1") + 1 >= min_lead
    if cap is not None:
        # Candidates that can't be among a leader's cap smallest keys of its band go before the join: a week's cap smallest suffice.
        some = partner.withColumn("_key", rand_key(seed, "seq1"))
        some = some.withColumn("_rn", F.row_number().over(Window.partitionBy("w1").orderBy("_key", "seq1"))).where(F.col("_rn") <= cap).drop("_rn")
        pairs = lead.join(some, "w1")
        pairs = pairs.withColumn("_rn", F.row_number().over(Window.partitionBy("seq0").orderBy("_key", "seq1"))).where((F.col("_rn") <= cap) & late)
        pairs = pairs.withColumn("count1", F.get("c1", F.col("o"))).where(F.col("period") >= LEAD_RATIO * F.col("gap"))
    else:
        counts = stored(partner.where(late).select("seq1", "w1", F.posexplode("c1").alias("o", "count1")), "partners")
        pairs = band_candidates(stored(near.select("seq0", "w1", "o", "gap", "period", "count0", "low", "high"), "leaders"), counts)
    pairs = pairs.where((F.col("count1") <= F.col("count0")) & (bracket(F.col("count1") / F.col("count0"), brackets) >= F.col("gap")))
    pairs = pairs.select("seq0", "count0", "seq1", "count1", "period")
    if with_weekly:
        marked = F.broadcast if _few(series) else lambda t: t
        for i in (0, 1):
            weekly = F.slice("counts", F.col("week") + 1, last_week - F.col("week") + 1)
            pairs = pairs.join(marked(series.select(F.col("m").alias(f"seq{i}"), weekly.alias(f"weekly_counts{i}"))), f"seq{i}")
        pairs = pairs.select("seq0", "count0", "seq1", "count1", "period", "weekly_counts0", "weekly_counts1")
    return pairs


def combine_regions(a: DataFrame, b: DataFrame, how: str = "intersection") -> DataFrame:
    """Sum of two series and the earlier first week; union takes a missing side as zeros."""
    right = b.select("m", F.col("week").alias("_w"), F.col("counts").alias("_c"))
    both = a.select("m", "week", "counts").join(right, "m", "inner" if how == "intersection" else "full")
    zeros = lambda c: F.transform(c, lambda _: F.lit(0.0))
    summed = F.zip_with(F.coalesce("counts", zeros(F.col("_c"))), F.coalesce("_c", zeros(F.col("counts"))), lambda x, y: x + y)
    out = both.select("m", F.least("week", "_w").alias("week"), summed.alias("counts"))
    return out.select("m", "week", F.element_at("counts", -1).alias("total"), "counts")


def pair_upsert(base: DataFrame, extra: DataFrame, keys: tuple[str, ...] = ("seq0", "seq1")) -> DataFrame:
    """Union in which a pair of ``extra`` replaces one of ``base``."""
    rows = base.withColumn("_p", F.lit(0)).unionByName(extra.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, "_p")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_p").alias("_r")).select(*keys, "_r.*").select(*base.columns)


def assign_to_splits(lists: DataFrame, pairs: DataFrame, n_train: int, n_val: int, n_test: int, seed: int) -> DataFrame:
    """(m, n, kind, split) for m of ``lists``: where its pairs are (train, val, test in this order), else at random by share.

    Each kind's new variants are dealt by itself, one at least to train and to val.
    """
    order = F.element_at(F.create_map(F.lit("train"), F.lit(0), F.lit("val"), F.lit(1), F.lit("test"), F.lit(2)), F.col("split"))
    held = pairs.select(F.col("seq0").alias("m"), order.alias("_p")).union(pairs.select("seq1", order)).groupBy("m").agg(F.min("_p").alias("_p"))
    rows = stored(lists.join(held, "m", "left"), "lists")
    new = random_rank(rows.where("_p is null"), seed, ["m"], "_rn", ("kind",))
    sizes = new.groupBy("kind").agg(F.count("*").alias("_n"))
    size = n_train + n_val + n_test
    part = lambda n: F.greatest(F.floor(F.col("_n") * n / size), F.lit(1))
    new = new.join(F.broadcast(sizes), "kind").withColumn("_p", F.when(F.col("_rn") <= part(n_train), 0).when(F.col("_rn") <= part(n_train) + part(n_val), 1).otherwise(2)).drop("_rn", "_n")  # sizes: a row a kind
    both = rows.where("_p is not null").unionByName(new)
    return both.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("_p") + 1)).drop("_p")


def stratum_draw(j: Column, n: Column, size: Column, key: Column) -> Column:
    """The j-th (from 0) of n different places below ``size``: a random one in the j-th of n equal strata."""
    low, high = (F.call_function("div", (j.cast("long") + i) * size, n) for i in (0, 1))
    return low + F.pmod(key, high - low)


def frequent_rare_pairs(lists: DataFrame, pairs: DataFrame, n_train: int, n_val: int, n_test: int, most: int = 5000, seed: int = 0) -> DataFrame:
    """``pairs`` (with split) and, replacing equal ones, every frequent variant with up to ``most`` rare ones of its split.

    A split's rare variants are ranked in a random order once. A frequent one draws that many different ranks,
    one in each of as many equal strata, and meets the rare ones by rank: no more pairs are made than are kept.
    """
    pairs = stored(pairs, "pairs")
    placed = stored(assign_to_splits(lists, pairs, n_train, n_val, n_test, seed), "placed")
    rare = random_rank(placed.where("kind = 'rare'"), f"{seed}-rare", ["m"], "_rn", ("split",))
    rare = stored(rare.select("split", (F.col("_rn") - 1).alias("_at"), F.col("m").alias("seq1"), F.col("n").cast("double").alias("count1")), "rare")
    sizes = F.broadcast(rare.groupBy("split").agg(F.count("*").alias("_size")))  # a row a split
    frequent = placed.where("kind = 'frequent'").join(sizes, "split").select("split", F.col("m").alias("seq0"), F.col("n").cast("double").alias("count0"), "_size", F.least("_size", F.lit(most).cast("long")).alias("_n"))
    draws = frequent.select("*", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("_j"))
    draws = draws.withColumn("_at", stratum_draw(F.col("_j"), F.col("_n"), F.col("_size"), rand_key(seed, "seq0", "_j")))
    made = draws.join(rare, ["split", "_at"]).select("seq0", "count0", "seq1", "count1", F.lit(None).cast("int").alias("period"), "split")
    return pair_upsert(pairs.select(*made.columns), made, ("split", "seq0", "seq1"))


def same_week_pairs(df: DataFrame, per_week: int | None = None, seed: int = 0) -> DataFrame:
    """(seq0, seq1, w, label): ordered pairs of variants first seen in the same week, as many per week as it has variants.

    ``df`` has weeks. The label is seq1's share of both totals. The pairs of a week are numbered, not made:
    every variant draws its part of the numbers, each in a stratum of its own, and the two variants of a number
    are found by their ranks in the week.
    """
    first = stored(df.groupBy("m").agg(F.min("w").alias("w"), F.count("*").alias("n")), "first")
    ranked = random_rank(first, f"{seed}-week", ["m"], "_rn", ("w",)).withColumn("_rn", F.col("_rn") - 1)
    sizes = first.groupBy("w").agg(F.count("*").alias("_k")).where("_k > 1").withColumn("_all", F.col("_k") * (F.col("_k") - 1))
    sizes = sizes.withColumn("_n", F.col("_k") if per_week is None else F.least(F.lit(per_week).cast("long"), F.col("_all")))
    draws = ranked.join(F.broadcast(sizes), "w").where(F.col("_rn") < F.col("_n"))  # a row a week
    draws = draws.select("w", "_k", "_all", "_n", F.explode(F.sequence("_rn", F.col("_n") - 1, F.col("_k"))).alias("_j"))
    draws = draws.withColumn("_q", stratum_draw(F.col("_j"), F.col("_n"), F.col("_all"), rand_key(seed, "w", "_j")))
    a, b = F.call_function("div", F.col("_q"), F.col("_k") - 1), F.pmod("_q", F.col("_k") - 1)
    draws = draws.select("w", a.alias("_a"), F.when(b >= a, b + 1).otherwise(b).alias("_b"))
    found = draws.join(ranked.select(F.col("m").alias("seq0"), "w", F.col("n").alias("n0"), F.col("_rn").alias("_a")), ["w", "_a"]).join(ranked.select(F.col("m").alias("seq1"), "w", F.col("n").alias("n1"), F.col("_rn").alias("_b")), ["w", "_b"])
    return found.select("seq0", "seq1", "w", pair_label("n0", "n1").alias("label"))


def pair_label(c0: str, c1: str, flip: Column | None = None) -> Column:
    """seq1's share of both counts, or seq0's where ``flip``."""
    share = F.col(c1) / (F.col(c0) + F.col(c1))
    return share if flip is None else F.when(flip, 1 - share).otherwise(share)


def min_loss(pairs: DataFrame) -> DataFrame:
    """Mean binary entropy of the pairs' shares: no model's loss is below it."""
    p = F.col("count1") / (F.col("count0") + F.col("count1"))
    term = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    return pairs.agg(F.avg(term(p) + term(1 - p)).alias("min_loss"))


def synthetic_negatives(pairs: DataFrame, known: DataFrame, n_mutations: int, trials: int, seed: int) -> DataFrame:
    """(seq0, count0, seq1, count1, period): variants of the pairs with random known mutations added, count 0.

    The known mutations are ranked in a random order once; a trial draws ranks by keys of its own, of which
    the first n different ones count, and meets the mutations by rank. A trial is void if fewer were drawn, if
    a place is taken already, or if the result is known.
    """
    seqs = pairs.select(F.col("seq0").alias("m")).union(pairs.select("seq1")).distinct()
    known = stored(known.select("m").distinct(), "known")
    pool = stored(random_rank(stored(known.select(F.explode(tokens("m")).alias("u")).distinct(), "mutations"), f"{seed}-pool", ["u"]), "pool")
    size = pool.agg(F.count("*").alias("_size")).where("_size > 0")  # one row
    rows = seqs.select("m", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial")).join(F.broadcast(size))
    draws = [F.pmod(rand_key(seed, "m", "trial", F.lit(j)), F.col("_size")) + 1 for j in range(2 * n_mutations + 2)]
    rows = rows.select("m", "trial", F.slice(F.array_distinct(F.array(*draws)), 1, n_mutations).alias("_d")).where(F.size("_d") == n_mutations)
    met = rows.select("m", "trial", F.explode("_d").alias("rn")).join(if_small(pool), "rn")
    rows = met.groupBy("m", "trial").agg(F.array_sort(F.collect_list(F.struct(position(F.col("u")).alias("p"), F.col("u")))).alias("add"))  # n_mutations of them
    rows = rows.where(~F.arrays_overlap(F.transform(tokens("m"), position), F.transform("add", lambda s: s["p"])))
    own = F.transform(tokens("m"), lambda u, i: F.struct(position(u).alias("p"), i.alias("i"), u.alias("u")))
    added = F.transform("add", lambda s, i: F.struct(s["p"].alias("p"), (i + 1_000_000).alias("i"), s["u"].alias("u")))
    rows = rows.withColumn("seq1", F.array_join(F.transform(F.array_sort(F.concat(own, added)), lambda s: s["u"]), ","))
    rows = rows.join(known.select(F.col("m").alias("seq1")), "seq1", "left_anti")
    return rows.select(F.col("m").alias("seq0"), F.lit(1.0).alias("count0"), "seq1", F.lit(0.0).alias("count1"), F.lit(None).cast("int").alias("period"))


def contingency_p(a0: int, a1: int, b0: int, b1: int, use_chi2: bool = False) -> float:
    """p of [[a0, b0], [a1, b1]]: chi-square where every cell, also expected, is large enough; else Fisher's exact test."""
    cells = np.array([[a0, b0], [a1, b1]], float)
    if use_chi2 and cells.sum():
        expected = np.outer(cells.sum(1), cells.sum(0)) / cells.sum()
        if min(cells.min(), expected.min()) >= CHI2_LEAST:
            return chi2_yates(a0, b0, a1, b1)
    return fisher_exact(int(a0), int(b0), int(a1), int(b1))


def _with_counts(rows: DataFrame, t: DataFrame, side: str) -> DataFrame:
    """``rows`` whose variants are both in the region's series, with its counts ``_<side>0`` and ``_<side>1`` at the end of
    the time that both were seen there.

    Few series are broadcast. Of many, the weeks asked for are gathered per variant, so that a series moves once
    per variant and not once per pair.
    """
    if _few(t):
        for i in (0, 1):
            rows = rows.join(F.broadcast(t.select(F.col("m").alias(f"seq{i}"), F.col("week").alias(f"_w{i}"), F.col("counts").alias(f"_c{i}"))), f"seq{i}")
        period = F.least(F.size("_c1") - F.col("_w0"), F.size("_c1") - F.col("_w1"))
        at = {f"_{side}{i}": F.element_at(f"_c{i}", (F.col(f"_w{i}") + period).cast("int")) for i in (0, 1)}
        return rows.withColumns(at).drop("_w0", "_w1", "_c0", "_c1")
    for i in (0, 1):
        rows = rows.join(t.select(F.col("m").alias(f"seq{i}"), F.col("week").alias(f"_w{i}"), F.size("counts").alias("_last")), f"seq{i}")
        rows = rows.drop("_last") if i == 0 else rows
    period = F.least(F.col("_last") - F.col("_w0"), F.col("_last") - F.col("_w1"))
    rows = stored(rows.withColumns({f"_at{i}": (F.col(f"_w{i}") + period).cast("int") for i in (0, 1)}).drop("_w0", "_w1", "_last"), "sided")
    asked = rows.select(F.col("seq0").alias("m"), F.col("_at0").alias("_at")).union(rows.select("seq1", "_at1"))
    asked = asked.groupBy("m").agg(F.collect_set("_at").alias("_ats"))  # at most one a week
    counts = asked.join(t.select("m", "counts"), "m").select("m", "counts", F.explode("_ats").alias("_at"))
    counts = counts.select("m", "_at", F.element_at("counts", F.col("_at")).alias("_c"))
    for i in (0, 1):
        rows = rows.join(counts.toDF(f"seq{i}", f"_at{i}", f"_{side}{i}"), [f"seq{i}", f"_at{i}"])
    return rows.drop("_at0", "_at1")


def validate_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, max_p_diff: float | None = None, p_value: float | None = None, cutoff: float = 1e-2, use_chi2: bool = False) -> DataFrame:
    """The pairs on whose direction and strength the regions' series a and b agree."""
    if not max_p_diff and not p_value:
        raise ValueError("one of max_p_diff and p_value is needed")
    rows = pairs
    for side, t in (("a", a), ("b", b)):
        rows = _with_counts(rows, t, side)
    shares = [F.col(y) / (F.col(x) + F.col(y) + F.lit(1e-12)) for x, y in (("count0", "count1"), ("_a0", "_a1"), ("_b0", "_b1"))]
    rows = rows.where(F.greatest(*shares) <= 0.5)
    if max_p_diff:
        rows = rows.where(F.greatest(*shares) - F.least(*shares) <= max_p_diff)
    if p_value:
        tested = F.col("count1") / (F.col("count0") + F.col("count1")) >= cutoff

        @F.pandas_udf("double")
        def p_of(a0: pd.Series, a1: pd.Series, b0: pd.Series, b1: pd.Series) -> pd.Series:
            return pd.Series([contingency_p(*map(int, t), use_chi2) for t in zip(a0, a1, b0, b1)], dtype=float)

        cells = ["_a0", "_a1", "_b0", "_b1"]
        # Tables are few bytes but cost much: dealt by a hash of their own, for an adaptive plan would join them to few tasks.
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tables = rows.where(tested).select(*cells).distinct().repartition(parts, F.xxhash64(*cells)).withColumn("_p", p_of.asNondeterministic()(*cells))
        rows = rows.join(tables, cells, "left").where(F.coalesce(~tested | (F.col("_p") >= p_value), F.lit(False)))
    return rows.select(*pairs.columns)
