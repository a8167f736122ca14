"""Evaluation of samples: novelty, curves, dated statistics, recall, rankings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrend.functions.dates import week_after
from seqtrend.functions.mutations import is_valid_sample
from seqtrend.functions.rand import rand_key
from seqtrend.functions.stats import t_quantile
from seqtrend.functions.tokens import discretise
from seqtrend.operators.broadcasts import ROWS, if_small
from seqtrend.operators.kmer_runs import MOST_K, ONLY_LETTERS, new_places
from seqtrend.operators.matching import close_matches
from seqtrend.operators.ranks import above_cuts, balanced_cuts, global_rank, prefix_sums
from seqtrend.operators.series import first_seen
from seqtrend.operators.wildcards import MARKS, digest, identified
from seqtrend.sources.scratch import stored

SALIENT = 10
PIECE = 256
#: Ranks of a run that one task sums up.
SEGMENT = 1 << 16


def kmers(df: DataFrame, k: int, *keys: str, seq: str = "seq") -> DataFrame:
    """(keys, kmer): one row per place. Keys are few bytes: a whole sequence would be copied to each of its k-mers.

    A sequence is cut into overlapping pieces first: a place is counted from the begin of its text, so the work
    stays in proportion to the length.
    """
    # Pieces are found in one pass; outer rows keep the arrays from being made again to see that they aren't empty.
    piece = F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{1,{PIECE + k - 1}}})).{{1,{PIECE}}}"), F.lit(1))
    pieces = df.select(*keys, F.explode_outer(piece).alias("_piece")).where(F.length("_piece") >= k)
    places = F.sequence(F.lit(1), F.length("_piece") - k + 1)
    made = F.transform(places, lambda i: F.substring(F.col("_piece"), i, F.lit(k)))
    return pieces.select(*keys, F.explode_outer(made).alias("kmer"))


def novel_places(asked: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(id, novelty) of distinct sequences (id, seq) that have any: at how many places the k-mer is in no known (id, seq).

    Few known k-mers are broadcast. Many are met in runs of places by their bucket; if a sequence has other letters than
    those which such a k-mer is a number of, both sides meet k-mer by k-mer.
    """
    letters, plain = F.coalesce(F.sum(F.length("seq")), F.lit(0)), F.coalesce(F.bool_and(F.col("seq").rlike(ONLY_LETTERS)), F.lit(True))
    size, known_plain = known.agg(letters, plain).first()
    if size > ROWS and k <= MOST_K:
        more, asked_plain = asked.agg(letters, plain).first()
        if known_plain and asked_plain:
            side = lambda t: t.where("seq is not null").select(F.col("id").alias("_id"), "seq")
            return new_places(side(asked), side(known), k, size + more).where("novelty > 0").withColumnRenamed("_id", "id")
    seen = kmers(known, k).distinct()
    seen = F.broadcast(seen) if size <= ROWS else if_small(stored(seen, "kmers"))
    return kmers(asked, k, "id").join(seen, "kmer", "left_anti").groupBy("id").agg(F.count("*").alias("novelty"))


def kmer_novelty(samples: DataFrame, known: DataFrame, k: int = 11) -> DataFrame:
    """(seq, novelty) per distinct sample: at how many places its k-mer is in no known sequence.

    Samples go by the MD5 of their sequence. One that is known itself has no new k-mer, and none of its are made.
    """
    distinct, every = (stored(t.select("seq").distinct().select("seq", digest("seq").alias("id")), "sequences") for t in (samples, known))
    fresh = novel_places(distinct.join(every.select("id"), "id", "left_anti"), every, k)
    return distinct.join(fresh, "id", "left").select("seq", F.coalesce("novelty", F.lit(0)).alias("novelty"))


def run_novelty(samples: DataFrame, known: DataFrame, k: int = 11) -> DataFrame:
    """(run, novelty, n_valid): mean over the distinct valid samples of a run."""
    valid = samples.where(is_valid_sample("seq")).select("run", "seq").distinct()
    return valid.join(kmer_novelty(valid, known, k), "seq").groupBy("run").agg(F.avg("novelty").alias("novelty"), F.count("*").alias("n_valid"))


def classify_samples(samples: DataFrame, obs: DataFrame, cutoff: str, k: int = 11) -> DataFrame:
    """Samples (run, seq, score) with old_seq, new_seq, false_seq, invalid_seq, count, novelty, lineage, seq_date, new_lineage.

    ``obs`` has seq. Old is known up to the cutoff, new only later (tested for what isn't old), false
    neither. An invalid sample has no other flag. A match by ambiguity letters has count 0. The lineages are
    those of the variant, all first seen after the cutoff for new_lineage; a lineage's date is the first one
    of a first sighting of any variant.
    """
    return classified(samples, obs, cutoff, k)[0].drop("_id")


def classified(samples: DataFrame, obs: DataFrame, cutoff: str, k: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``classify_samples`` with the digest ``_id``, the stored samples (run, seq, score, _id, _ok), and the stored
    ``sequences`` of the valid ones, as both sides.

    Each input is read once, and each text is shuffled once: what follows meets by digests.
    """
    rows = stored(samples.select("run", "seq", "score", digest("seq").alias("_id"), is_valid_sample("seq").alias("_ok")), "samples")
    seen = stored(obs.select("seq", digest("seq").alias("_id"), "m", "d", "acc", "lineage"), "observations")
    dates = stored(first_seen(seen.select("m", "d", "acc", "lineage"), "m").groupBy("lineage").agg(F.min("d").alias("_first")), "dates")
    by_m = seen.groupBy("_id", "m").agg(F.count("*").alias("n"), F.collect_set("lineage").alias("ls"), F.min("d").alias("d"))
    by_seq = by_m.groupBy("_id").agg(F.max_by("n", "m").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ls")))).alias("ls"), F.min("d").alias("d"))
    day = F.lit(cutoff).cast("date")
    both = rows.where("_ok").select("seq", F.lit(True).alias("asked"), F.lit(None).cast("date").alias("d")).union(seen.select("seq", F.lit(False), "d"))
    both = both.where("seq is not null").groupBy("seq").agg(F.max("asked").alias("asked"), F.min("d").alias("d"))
    age = F.when(F.col("d") <= day, "old").when(F.col("d") > day, "new")
    every = stored(both.select(*identified(), "asked", age.alias("age"), "seq"), "sequences")
    sides = lambda t, a, b: close_matches(t.select(*MARKS, F.expr(a).alias("in_a"), F.expr(b).alias("in_b"), "seq"))
    old = sides(every, "asked and not age <=> 'old'", "age <=> 'old'")
    found = if_small(old.select("id"))
    new = sides(every.join(found.withColumn("_hit", F.lit(True)), "id", "left"), "asked and age is null and _hit is null", "age <=> 'new'")
    exact = every.where("asked and age is not null").select("id", "age").join(found, "id", "left_anti").select("id", F.col("id").alias("_id"), F.lit(True).alias("exact"), "age")
    close = [t.select("id", digest("matched").alias("_id"), F.lit(False).alias("exact"), F.lit(x).alias("age")) for t, x in ((old, "old"), (new, "new"))]
    facts = stored(exact.union(close[0]).union(close[1]).join(by_seq, "_id").drop("_id"), "facts")
    late = facts.select("id", F.explode("ls").alias("lineage")).join(if_small(dates), "lineage").groupBy("id").agg(F.min("_first").alias("_first"))
    facts = facts.join(late, "id", "left").select(F.col("id").alias("_id"), "age", F.when(F.col("exact"), F.col("n")).otherwise(0).alias("count"), F.col("ls").alias("lineage"), F.col("d").alias("seq_date"), F.coalesce(F.col("_first") > day, F.lit(False)).alias("new_lineage"))
    novelty = stored(novel_places(every.where("asked and not age <=> 'old'"), every.where("age <=> 'old'"), k).withColumnRenamed("id", "_id"), "novelty")
    flag = lambda c: (F.col("_ok") & F.coalesce(c, F.lit(False)))
    out = rows.join(facts, "_id", "left").join(if_small(novelty), "_id", "left").select(
        "run", "seq", "score", flag(F.col("age") == "old").alias("old_seq"), flag(F.col("age") == "new").alias("new_seq"), flag(F.col("age").isNull()).alias("false_seq"), (~F.col("_ok")).alias("invalid_seq"),
        F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("novelty", F.lit(0)).alias("novelty"), "lineage", "seq_date", F.coalesce("new_lineage", F.lit(False)).alias("new_lineage"), "_id",
    )
    return out, rows, every.where("asked").select(*MARKS, F.lit(True).alias("in_a"), F.lit(True).alias("in_b"), "seq")


def new_lineage_flags(samples: DataFrame, order: str = "rank", blocking: Column | None = None) -> DataFrame:
    """``samples`` with counts_lineage: a new hit of new lineages none of which an earlier-ranked row of the run had.

    ``blocking``: which rows' lineages count as had; all by default.
    """
    each = samples.where(blocking if blocking is not None else F.lit(True)).select("run", order, F.explode("lineage").alias("_l"))
    first = each.groupBy("run", "_l").agg(F.min(order).alias("_first"))
    mine = samples.select("run", F.col(order).alias("_r"), F.explode("lineage").alias("_l")).join(first, ["run", "_l"], "left")
    late = mine.groupBy("run", F.col("_r").alias(order)).agg(F.max(F.coalesce(F.col("_first") < F.col("_r"), F.lit(False))).alias("_late"))
    rows = samples.join(late, ["run", order], "left")
    return rows.withColumn("counts_lineage", F.col("new_seq") & F.col("new_lineage") & ~F.coalesce("_late", F.lit(False))).drop("_late")


def run_stats(samples: DataFrame) -> DataFrame:
    """One row per run over its distinct valid samples (first by rank): the 14 figures of a run."""
    first = samples.where("not invalid_seq").groupBy("run", "seq").agg(F.min("rank").alias("rank"))
    rows = new_lineage_flags(samples.join(first, ["run", "seq", "rank"], "left_semi"))
    new, n = F.col("new_seq"), F.count("*")
    found = F.count_if(new)
    counts = F.coalesce(F.sum(F.when(new, F.col("count"))), F.lit(0))
    novel = F.count_if(~F.col("old_seq"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.groupBy("run").agg(
        n.alias("n_valid"), found.alias("n_new"), F.count_if("false_seq").alias("n_false"), F.count_if("old_seq").alias("n_old"), F.avg("novelty").alias("avg_novelty"),
        (F.count_if("old_seq") / n).alias("old_rate"), (found / n).alias("new_rate"), share(found, found + F.count_if("false_seq")).alias("ppv"), counts.alias("counts"), novel.alias("n_non_old"),
        F.count_if("counts_lineage").alias("n_new_lineages"), share(counts, found).alias("count_per_forecast"), share(counts, novel).alias("count_per_novel"),
        F.count_if(new & (F.col("count") >= SALIENT)).alias("n_salient"),
    )


def precision_curve(samples: DataFrame, kind: str = "NOVEL") -> DataFrame:
    """(run, rank, fp, tp, tp_count, rate) along the ranks; NOVEL counts false rows only, ALL every other valid row."""
    if kind not in ("NOVEL", "ALL"):
        raise ValueError(f"no kind {kind!r}")
    wrong = ~F.col("new_seq") & ~F.col("invalid_seq") & (F.col("false_seq") if kind == "NOVEL" else F.lit(True))
    rows = samples.where(F.col("new_seq") | wrong)
    new = F.col("new_seq")
    sums = {"fp": (~new).cast("long"), "tp": new.cast("long"), "tp_count": F.when(new, F.col("count")).otherwise(0)}
    out = prefix_sums(rows.select("run", "rank", "new_seq", "count"), "run", F.floor(F.col("rank") / SEGMENT), [F.col("rank")], sums)
    return out.select("run", "rank", "fp", "tp", "tp_count", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("rate"))


def with_place(curve: DataFrame) -> DataFrame:
    """The curve with the place, from 1, of each row in its run."""
    return prefix_sums(curve, "run", F.floor(F.col("rank") / SEGMENT), [F.col("rank")], {"place": F.lit(1).cast("long")})


def at_ranks(curve: DataFrame, ranks: list[int]) -> DataFrame:
    """The curve's rows at these places (from 1) of each run."""
    return with_place(curve).where(F.col("place").isin(*ranks))


def discovery_curve(best: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """(run, metric, fp, tp): running counts by falling metric without the known ones; ties are one step."""
    rows = best.join(known.select("child").distinct(), "child", "left_anti").join(new.select("child").distinct().withColumn("_new", F.lit(1)), "child", "left")
    steps = stored(rows.groupBy("run", "metric").agg(F.count("_new").alias("_t"), F.count("*").alias("_n")), "steps")
    cuts = balanced_cuts(steps, "metric")
    out = prefix_sums(steps, "run", -above_cuts("metric", cuts), [F.desc("metric")], {"fp": F.col("_n") - F.col("_t"), "tp": F.col("_t")})
    return out.select("run", "metric", "fp", "tp")


def mean_ci(stats: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, err, n): mean and half width of its 95 % t-interval; null for one run, 0 without spread.

    The quantile of t is computed once per distinct number of runs.
    """

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return n.map(lambda k: t_quantile(0.975, int(k) - 1))

    out = stats.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"), F.count(value).alias("n"))
    table = out.select("n").where("n > 1").distinct().withColumn("_t", quantile.asNondeterministic()("n"))
    return out.join(table, "n", "left").select(*by, "mean", (F.col("_t") * F.col("_s") / F.sqrt("n")).alias("err"), "n")


def mean_ci_by_place(curves: DataFrame, by: list[str], value: str, run: str = "run", place: str = "place") -> DataFrame:
    """mean_ci per place of rank- or week-indexed lists, as far as the shortest run of the group goes."""
    lengths = curves.groupBy(*by, run).agg(F.max(place).alias("_n")).groupBy(*by).agg(F.min("_n").alias("_short"))
    return mean_ci(curves.join(if_small(lengths), by).where(F.col(place) <= F.col("_short")), [*by, place], value)


def period_stats(samples: DataFrame, cutoff: str, n_periods: int, period: int = 7, cumulative: bool = False) -> DataFrame:
    """(run, period, case_counts, seq_counts, lineage_counts, salient_counts, salient_ratio) for periods 1 to n.

    Over new valid hits in the order of date, then score; only new-lineage hits block a lineage.
    """
    rows = samples.where(F.col("new_seq") & ~F.col("invalid_seq")).withColumn("period", week_after("seq_date", F.lit(cutoff).cast("date"), period))
    rows = stored(rows, "hits")
    # Ranked by day and part of the scores, so that a run is ranked in many tasks.
    rows = global_rank(rows, [F.col("seq_date"), -above_cuts("score", balanced_cuts(rows, "score"))], [F.desc("score"), F.col("seq")], "_at", ("run",))
    rows = rows.where(F.col("period").between(1, n_periods))
    rows = new_lineage_flags(rows, "_at", F.col("new_lineage"))
    made = rows.groupBy("run", "period").agg(F.sum("count").alias("case_counts"), F.count("*").alias("seq_counts"), F.count_if("counts_lineage").alias("lineage_counts"), F.count_if(F.col("count") >= SALIENT).alias("salient_counts"))
    grid = samples.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), F.lit(n_periods))).alias("period"))
    names = ["case_counts", "seq_counts", "lineage_counts", "salient_counts"]
    full = grid.join(made, ["run", "period"], "left").fillna(0, names)
    if cumulative:
        along = Window.partitionBy("run").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full = full.select("run", "period", *[F.sum(c).over(along).alias(c) for c in names])
    return full.withColumn("salient_ratio", F.when(F.col("seq_counts") > 0, F.col("salient_counts") / F.col("seq_counts")).otherwise(0.0))


def weekly_recall(samples: DataFrame, obs: DataFrame, cutoff: str, n_weeks: int, min_count: int = SALIENT) -> DataFrame:
    """Per run and week 1 to n after the cutoff: found and all variants, salient variants and lineages first seen then,
    with shares and running sums of what was found. ``samples`` has run, m, new_seq."""
    week = lambda d: (F.floor((F.datediff(d, F.lit(cutoff).cast("date")) - 1) / 7) + 1).cast("int")
    variants = obs.groupBy("m").agg(F.min("d").alias("d"), F.count("*").alias("n")).withColumn("week", week("d")).where(F.col("week").between(1, n_weeks))
    lineages = obs.groupBy("lineage").agg(F.min("d").alias("d")).withColumn("week", week("d")).where(F.col("week").between(1, n_weeks)).select("lineage", "week")
    hits = samples.where("new_seq").select("run", "m").join(variants, "m").groupBy("run", "week").agg(F.count("*").alias("found"), F.count_if(F.col("n") >= min_count).alias("salient"))
    of_m = obs.select("m", "lineage").distinct().join(lineages, "lineage")
    lines = samples.where("new_seq").select("run", "m").distinct().join(of_m, "m").groupBy("run", "week").agg(F.countDistinct("lineage").alias("lineages"))
    every = variants.groupBy("week").agg(F.count("*").alias("all_found"), F.count_if(F.col("n") >= min_count).alias("all_salient"))
    every = every.join(lineages.groupBy("week").agg(F.count("*").alias("all_lineages")), "week", "full")
    grid = samples.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), F.lit(n_weeks))).alias("week"))
    rows = grid.join(hits, ["run", "week"], "left").join(lines, ["run", "week"], "left").join(F.broadcast(every), "week", "left").fillna(0)  # every: one row a week, n_weeks at most
    along = Window.partitionBy("run").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b).cast("double"), F.lit(1e-12))
    return rows.select("run", "week", "found", "salient", "lineages", "all_found", "all_salient", "all_lineages", ratio("salient", "found").alias("salient_fraction"), ratio("found", "all_found").alias("recall"), F.sum("found").over(along).alias("found_so_far"))


def roc_auc(scores: DataFrame, truth: DataFrame, cutoff: float = 50, missing: float = -100.0) -> DataFrame:
    """(auc, positives, negatives): positives have a count of ``cutoff`` or more; a missing score is very low.

    Rows are counted per distinct score first, so the running sums go over distinct scores only, in two steps:
    inside groups of scores of about equal size, and over the groups.
    """
    rows = truth.join(scores, "m", "left").select(F.coalesce("score", F.lit(missing)).alias("s"), (F.col("count") >= cutoff).cast("long").alias("y"))
    steps = rows.groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    group = above_cuts("s", balanced_cuts(steps, "s"))
    sums = steps.groupBy(group.alias("g")).agg(F.sum("q").alias("gq"))
    before = sums.select("g", F.coalesce(F.sum("gq").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("q").over(Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = steps.withColumn("g", group).withColumn("_i", inside).join(before, "g")
    wins = F.sum(F.col("p") * (F.col("_b") + F.col("_i") + F.col("q") / 2))
    out = below.agg(wins.alias("_w"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    return out.select((F.col("_w") / (F.col("positives") * F.col("negatives"))).alias("auc"), "positives", "negatives")


def classification_report(df: DataFrame, ranges: list[tuple[float, float]] = [(0, 0.5), (0.5, 1)]) -> DataFrame:  # noqa: B006
    """(part, micro_f1, macro_f1, n) of (pred, label): fake has label 0 or 1, real the others, and overall."""
    fake = F.col("label").isin(0.0, 1.0)
    parts = F.array(F.lit("overall"), F.when(fake, F.lit("fake")).otherwise("real"))
    rows = df.select(F.explode(parts).alias("part"), discretise("label", ranges).alias("t"), discretise("pred", ranges).alias("p"))
    cells = rows.groupBy("part", "t", "p").agg(F.count("*").alias("n"))
    each = cells.select("part", F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("is_t")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_t")))).alias("e"), "t", "p", "n")
    classes = each.groupBy("part", "e.c").agg(F.sum(F.when((F.col("t") == F.col("p")) & (F.col("e.is_t") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"))
    macro = classes.groupBy("part").agg(F.avg(2 * F.col("tp") / F.col("both")).alias("macro_f1"))
    micro = cells.groupBy("part").agg((F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("micro_f1"), F.sum("n").alias("n"))
    return micro.join(macro, "part").select("part", "micro_f1", "macro_f1", "n")


def confusion(df: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    return df.groupBy(discretise("label", ranges).alias("truth"), discretise("pred", ranges).alias("predicted")).agg(F.count("*").alias("n"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Sums over all rows' number: mean potential of the valid, of the valid and novel; and counts."""
    of = lambda c: F.sum(F.when(c, F.col("potential")).otherwise(0.0)) / F.count("*")
    novel = F.col("valid") & ~F.col("known")
    return scores.agg(of(F.col("valid")).alias("mean_valid"), of(novel).alias("mean_novel"), F.count_if("valid").alias("n_valid"), F.count_if(novel).alias("n_novel"), F.count("*").alias("n"))


def quantile_bounds(scores: DataFrame, spec: list[float]) -> DataFrame:
    """(q, low, high): half-open score ranges from low to high; the cut of a share q is the ceil(q n)-th best score.

    Rows are counted per score; scores are dealt to groups of about equal size, and only the groups in which a
    wanted rank falls are summed up score by score.
    """
    steps = scores.where("score is not null").groupBy("score").agg(F.count("*").alias("_c"))
    steps = steps.withColumn("_g", -above_cuts("score", balanced_cuts(steps, "score")))
    sizes = steps.groupBy("_g").agg(F.sum("_c").alias("_n"))  # at most 128 rows
    upto = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_g"))
    groups = sizes.select("_g", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"))
    total = sizes.agg(F.sum("_n").alias("_all"))
    wanted = scores.sparkSession.createDataFrame([(i, float(q)) for i, q in enumerate(spec)], "i int, share double")
    at = wanted.join(F.broadcast(total)).select("i", F.ceil(F.col("share") * F.col("_all")).alias("_rn"))
    at = at.join(F.broadcast(groups), F.col("_rn").between(F.col("_before") + 1, F.col("_upto")))  # one row a share
    inside = F.sum("_c").over(Window.partitionBy("_g").orderBy(F.desc("score")))
    held = steps.join(F.broadcast(at.select("_g").distinct()), "_g", "left_semi").withColumn("_in", inside)
    rn = F.col("_rn") - F.col("_before")
    cuts = held.join(F.broadcast(at), "_g").where((rn <= F.col("_in")) & (rn > F.col("_in") - F.col("_c"))).select("i", "score")
    ends = cuts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "score"))), lambda s: s["score"]).alias("c"))  # one value a share
    inf = F.lit(float("inf"))
    bounds = ends.select(F.concat(F.array(inf), "c", F.array(-inf)).alias("b"))
    n = len(spec)
    return bounds.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((n - i).alias("q"), F.get("b", i + 1).alias("low"), F.get("b", i).alias("high")))).alias("s")).select("s.*")


def assign_quantile(scores: DataFrame, bounds: DataFrame) -> DataFrame:
    """``scores`` with quantile; a known sequence gets the index after the last range."""
    ranges = bounds.agg(F.collect_list(F.struct("q", "low", "high")).alias("_b"), F.count("*").cast("int").alias("_top"))  # a handful
    inside = lambda b: (F.col("score") >= b["low"]) & (F.col("score") < b["high"])
    hit = F.get(F.filter("_b", inside), F.lit(0))["q"]
    rows = scores.join(F.broadcast(ranges))
    return rows.withColumn("quantile", F.when(F.col("known"), F.col("_top")).otherwise(hit)).drop("_b", "_top")


def merge_runs(results: DataFrame, tool: str, n: int, seed: int = 0) -> DataFrame:
    """``results`` with the runs of every tool dealt into n merged runs at random; an indivisible number is an error."""
    runs = results.select(tool, "run").distinct()
    place = F.row_number().over(Window.partitionBy(tool).orderBy(rand_key(seed, "run"), "run"))
    size = F.count("*").over(Window.partitionBy(tool))
    merged = F.when(size % n == 0, F.concat_ws("/", tool, F.pmod(place - 1, F.lit(n)).cast("string"))).otherwise(F.raise_error(F.concat(F.lit("can't be merged: "), F.col(tool))).cast("string"))
    return results.join(runs.withColumn("merged_run", merged), [tool, "run"])


def best_per_child(generations: DataFrame, metric: Column | str = "ll") -> DataFrame:
    """(generation, child, parent, metric): the best of every child in a generation."""
    m = F.col(metric) if isinstance(metric, str) else metric
    rows = generations.withColumn("_m", m)
    return rows.groupBy("generation", "child").agg(F.max(F.struct("_m", "parent")).alias("b")).select("generation", "child", "b.parent", F.col("b._m").alias("metric"))


def collapse(best: DataFrame) -> DataFrame:
    """The best of every child over all generations."""
    return best.groupBy("child").agg(F.max(F.struct("metric", "generation", "parent")).alias("b")).select("child", "b.generation", "b.parent", "b.metric")


def next_generation(candidates: DataFrame, parents: DataFrame, exclusions: DataFrame, k: int, by: str = "orig") -> DataFrame:
    """The k best per ``by``: score plus the parent's, best per sequence, without the excluded."""
    scored = candidates.join(parents.select(by, F.col("seq").alias("parent"), F.col("score").alias("_p")), [by, "parent"]).withColumn("score", F.col("score") + F.col("_p"))
    best = scored.groupBy(by, "seq").agg(F.max(F.struct("score", "parent")).alias("b")).select(by, "seq", "b.*")
    best = best.join(exclusions.select("seq").distinct(), "seq", "left_anti")
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "seq"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select(by, "seq", "parent", "score", "rank")


def attach_scores(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """``samples`` with ``metric``, inner."""
    return samples.join(scores.select("seq", F.col("score").alias("metric")), "seq")


def to_score(samples: DataFrame) -> DataFrame:
    """Distinct valid sequences."""
    return samples.where(is_valid_sample("seq")).select("seq").distinct()


def add_prior(generations: DataFrame, shares: DataFrame) -> DataFrame:
    """First-generation metrics plus ln(share of the parent); a parent without a share is an error."""
    rows = generations.join(shares.select(F.col("seq").alias("parent"), "share"), "parent", "left")
    prior = F.when(F.col("share").isNotNull(), F.log("share")).otherwise(F.raise_error(F.concat(F.lit("no share: "), "parent")).cast("double"))
    return rows.withColumn("metric", F.when(F.col("generation") == 1, F.col("metric") + prior).otherwise(F.col("metric"))).drop("share")
