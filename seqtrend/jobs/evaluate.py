"""Samples of several runs -> classified samples, statistics and curves per run, and means with intervals per tool.

spark-submit seqtrend/jobs/evaluate.py SAMPLES OBSERVATIONS REFERENCE OUT --cutoff DATE [--tools FILE] [...]
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrend.functions.mutations import apply_mutations
from seqtrend.jobs.common import arguments, session
from seqtrend.operators import evaluate, matching
from seqtrend.operators.broadcasts import if_small
from seqtrend.operators.ranks import above_cuts, balanced_cuts, global_rank
from seqtrend.sources.scratch import scratch_tables, stored
from seqtrend.sources.tables import load_normalised, read_samples

BY = ["tool", "setting"]


def figures(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, figure, value): a row per number of the table."""
    names = [c for c in table.columns if c not in keys]
    return table.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(keys, names, "figure", "value")


def run(samples: DataFrame, obs: DataFrame, cutoff: str, n_weeks: int = 75, n_periods: int = 18, period: int = 28, tools: DataFrame | None = None) -> dict[str, DataFrame]:
    """samples (run, seq, score), obs (m, seq, d, acc, lineage): the tables below, by name.

    classified: the samples, ranked by score per run. stats, curves, periods: a row per run, per run, kind and
    place, and per run, kind and period; of equal or compatible samples of a run the first counts. Weeks are
    cumulative, periods are not. means, curve_means, period_means: every figure's mean with its interval per
    tool and setting, lists place by place as far as the shortest run goes. ``tools`` has (run, tool, setting);
    without it a run's tool is the first part of its name, up to ``-``, and the setting is empty.
    """
    rows, given, every = evaluate.classified(samples, obs, cutoff)
    # Digests stand for the sequences; a text is looked up only where it orders samples of one run and score.
    flags = stored(rows.drop("seq"), "flags")
    ties = flags.groupBy("run", "score").agg(F.count("*").alias("_n")).where("_n > 1")
    tied = given.join(ties.select(F.col("run").alias("_run"), F.col("score").alias("_score")), F.col("run").eqNullSafe(F.col("_run")) & F.col("score").eqNullSafe(F.col("_score")), "left_semi")
    tied = tied.select("_id", F.col("seq").alias("_tie")).distinct()
    parts = [-above_cuts("score", balanced_cuts(flags, "score"))]
    ranked = global_rank(flags.join(tied, "_id", "left"), parts, [F.desc("score"), F.col("_tie")], "rank", ("run",))
    ranked = stored(ranked.drop("_tie").withColumn("rank", F.col("rank").cast("int")), "ranked")
    texts = given.select(F.col("_id").alias("_of"), "seq").distinct()
    classified = ranked.join(texts, F.col("_id").eqNullSafe(F.col("_of"))).select("run", "seq", *[c for c in ranked.columns if c not in ("run", "_id")])
    kept = matching.first_of_alike(ranked.where("not invalid_seq"), every)
    # Their ranks are as unique in a run as the sequences, and in the same order where scores are equal.
    valid = stored(ranked.join(kept, ["run", "_id", "rank"], "left_semi").drop("_id").withColumn("seq", F.col("rank")), "unique")
    stats = stored(evaluate.run_stats(valid), "stats")
    curves = [evaluate.with_place(evaluate.precision_curve(valid, kind)).select(F.lit(kind).alias("kind"), "*").drop("rank") for kind in ("NOVEL", "ALL")]
    curves = stored(curves[0].union(curves[1]), "curves")
    weeks = evaluate.period_stats(valid, cutoff, n_weeks, 7, cumulative=True).select(F.lit("week").alias("kind"), "*")
    periods = evaluate.period_stats(valid, cutoff, n_periods, period).select(F.lit("period").alias("kind"), "*")
    periods = stored(weeks.union(periods), "periods")
    if tools is None:
        tools = stats.select("run", F.substring_index("run", "-", 1).alias("tool"), F.lit("").alias("setting"))
    tools = if_small(stored(tools.select("run", *BY), "tools"))
    named = lambda t: t.join(tools, "run")
    return {
        "classified": classified, "stats": stats, "curves": curves, "periods": periods,
        "means": evaluate.mean_ci(named(figures(stats, ["run"])), [*BY, "figure"], "value"),
        "curve_means": evaluate.mean_ci_by_place(named(figures(curves, ["run", "kind", "place"])), [*BY, "kind", "figure"], "value"),
        "period_means": evaluate.mean_ci_by_place(named(figures(periods, ["run", "kind", "period"])), [*BY, "kind", "figure"], "value", place="period"),
    }


def main(argv: list[str] | None = None) -> None:
    parser = arguments(__doc__, "samples", "observations", "reference", "out")
    parser.add_argument("--cutoff", required=True)
    parser.add_argument("--score", default="ll", help="field of the samples that ranks them")
    parser.add_argument("--level", type=int, default=-1, help="-1: a run is a file, -2: a folder")
    parser.add_argument("--tools", help="JSON lines of run, tool, setting")
    parser.add_argument("--weeks", type=int, default=75)
    parser.add_argument("--periods", type=int, default=18)
    parser.add_argument("--period", type=int, default=28, help="days of a period")
    a, spark = parser.parse_args(argv), session("evaluate")
    reference = spark.read.text(a.reference, wholetext=True).first()[0].strip()  # one sequence
    obs = apply_mutations(load_normalised(spark, a.observations), reference)
    tools = spark.read.schema("run string, tool string, setting string").json(a.tools) if a.tools else None
    with scratch_tables(spark):
        made = run(read_samples(spark, a.samples, a.score, a.level), obs, a.cutoff, a.weeks, a.periods, a.period, tools)
        for name, table in made.items():
            table.write.parquet(f"{a.out}/{name}")


if __name__ == "__main__":
    main()
