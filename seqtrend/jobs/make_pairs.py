"""Normalised observations -> ranked pairs of variants per split.

spark-submit seqtrend/jobs/make_pairs.py OBSERVATIONS OUT --until DATE --primary A,B [--control ~A,B] [...]

Without a control region pairs are kept as they are made; with one they are kept where both regions agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrend.jobs.common import arguments, session
from seqtrend.operators import pairs, ranks, series
from seqtrend.sources.scratch import scratch_tables, stored
from seqtrend.sources.tables import cap_rows, load_normalised

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Frequent:
    """When a variant is frequent or rare, and with how many rare ones a frequent one is paired."""

    min_count: int
    max_total: int
    trailing: int
    most_rare: int


def last_week_of(obs: DataFrame, until: str, period: int = 7) -> int | None:
    """The number of the period that holds the date, from the first date of all observations on."""
    first = obs.agg(F.min("d")).select(F.floor(F.datediff(F.lit(until).cast("date"), "min(d)") / period)).first()[0]  # one row
    return None if first is None else int(first)


def region_series(rows: DataFrame, primary: str, control: str | None, last_week: int, how: str, discovery: str | None) -> list[DataFrame]:
    """[series of both], or [series of both, of the primary region, of the control]."""
    one = [stored(series.variant_series(rows.where(series.in_locations(x)), last_week, discovery), "series") for x in (primary, control) if x]
    return one if control is None else [pairs.combine_regions(*one, how), *one]


def run(
    obs: DataFrame,
    primary: str,
    control: str | None = None,
    until: str | None = None,
    last_week: int | None = None,
    period: int = 7,
    discovery: str | None = None,
    blocks: tuple[int, int, int] = (4, 1, 0),
    given: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    how: str = "intersection",
    cap: int | None = None,
    min_lead: int = pairs.MIN_LEAD,
    to_check: int | None = None,
    p_value: float | None = None,
    cutoff: float = 1e-2,
    use_chi2: bool = False,
    max_p_diff: float | None = None,
    frequent: Frequent | None = None,
    n_mutations: int | None = None,
    trials: tuple[int, int] = (1, 1),
    seed: int = 0,
) -> DataFrame:
    """(seq0, count0, seq1, count1, period, split).

    Periods count from the first date of all locations, up to ``last_week`` or to that of ``until``. Variants not
    seen by ``discovery`` are left out, their counts run on. The series of both regions are combined and split
    in blocks of ranks, or by the ``given`` lists of variants (train, val, test). All pairs inside
    the splits are made, and with a control region all are held against both; ``cap`` leaves every variant that many
    partners, and ``to_check`` every split that many pairs to be held against the regions, at random.
    With ``frequent``, frequent variants are paired with rare ones; with ``n_mutations``, made-up variants of
    count 0 are added in so many trials per variant of train, and of val and test.
    """
    if last_week is None:
        last_week = last_week_of(obs, until, period)
    rows = stored(series.with_week(obs.select("location", "d", "m"), period), "weeks")
    both, *sides = region_series(rows, primary, control, last_week, how, discovery)
    split = ranks.apply_precomputed_split(both, *given) if given else ranks.split_by_rank_blocks(both, *blocks, seed)
    split = stored(split, "split")
    parts = [pairs.week_band_pairs(split.where(F.col("split") == s).drop("split"), last_week, cap, seed, min_lead=min_lead).withColumn("split", F.lit(s)) for s in SPLITS]
    made = parts[0].union(parts[1]).union(parts[2])
    if sides:
        made = made if to_check is None else cap_rows(made, to_check, seed, "split", ["seq0", "seq1"])
        made = pairs.validate_pairs(stored(made, "pairs"), *sides, max_p_diff, p_value, cutoff, use_chi2)
    if frequent:
        lists = series.frequent_and_rare(rows, frequent.trailing, frequent.min_count, frequent.max_total)
        made = pairs.frequent_rare_pairs(lists, made, *blocks, most=frequent.most_rare, seed=seed)
    made = stored(made, "pairs")
    if n_mutations:
        known = stored(rows.select("m").distinct(), "known")
        for s, times in zip(SPLITS, (trials[0], trials[1], trials[1])):
            fake = pairs.synthetic_negatives(made.where(F.col("split") == s), known, n_mutations, times, seed)
            parts.append(fake.withColumn("split", F.lit(s)))
        made = made.unionByName(parts[3]).unionByName(parts[4]).unionByName(parts[5])
    return made


def main(argv: list[str] | None = None) -> None:
    parser = arguments(__doc__, "observations", "out")
    parser.add_argument("--until", required=True, help="last date that counts")
    parser.add_argument("--discovery", help="variants not seen by this date are left out")
    parser.add_argument("--primary", required=True, help="locations A,B, or ~A,B for all others")
    parser.add_argument("--control", help="the region that pairs are held against")
    parser.add_argument("--period", type=int, default=7, help="days of a period")
    parser.add_argument("--blocks", type=int, nargs=3, default=(4, 1, 0), metavar=("TRAIN", "VAL", "TEST"))
    parser.add_argument("--given", nargs=3, metavar=("TRAIN", "VAL", "TEST"), help="text files of variants, instead of blocks")
    parser.add_argument("--combine", choices=("intersection", "union"), default="intersection")
    parser.add_argument("--cap", type=int, help="partners of a variant, at random; all by default")
    parser.add_argument("--min-lead", type=int, default=pairs.MIN_LEAD)
    parser.add_argument("--to-check", type=int, help="pairs of a split that are held against the regions, at random; all by default")
    parser.add_argument("--p-value", type=float)
    parser.add_argument("--cutoff", type=float, default=1e-2, help="share from which a pair is tested")
    parser.add_argument("--chi2", action="store_true")
    parser.add_argument("--max-p-diff", type=float)
    parser.add_argument("--frequent", type=int, nargs=4, metavar=("MIN_COUNT", "MAX_RARE", "TRAILING", "MOST"), help="pairs of frequent and rare variants")
    parser.add_argument("--mutations", type=int, help="random mutations of a made-up variant")
    parser.add_argument("--trials", type=int, nargs=2, default=(1, 1), metavar=("TRAIN", "VAL"))
    parser.add_argument("--randomizations", type=int, default=1, help="runs with seeds of their own")
    parser.add_argument("--reconstructed", action="store_true", help="only rows whose record agrees with them")
    parser.add_argument("--max-rows", type=int, nargs=3, metavar=("TRAIN", "VAL", "TEST"))
    a = parser.parse_args(argv)
    if a.given and a.randomizations > 1:
        parser.error("given splits leave nothing to randomize")
    spark = session("make_pairs")
    obs = load_normalised(spark, a.observations, end=a.until, labelled=True)
    obs = obs.where("reconstructed") if a.reconstructed else obs
    given = tuple(spark.read.text(path).withColumnRenamed("value", "m") for path in a.given) if a.given else None
    for i in range(a.randomizations):
        with scratch_tables(spark):
            made = run(
                obs, a.primary, a.control, a.until, None, a.period, a.discovery, tuple(a.blocks), given, a.combine, a.cap, a.min_lead, a.to_check, a.p_value, a.cutoff, a.chi2, a.max_p_diff,
                Frequent(*a.frequent) if a.frequent else None, a.mutations, tuple(a.trials), a.seed + i,
            )
            if a.max_rows:
                cut = [cap_rows(made.where(F.col("split") == s), n, a.seed, "split", ["seq0", "seq1"]) for s, n in zip(SPLITS, a.max_rows)]
                made = cut[0].union(cut[1]).union(cut[2])
            made.write.partitionBy("split").json(a.out if a.randomizations == 1 else f"{a.out}/run={i}")


if __name__ == "__main__":
    main()
