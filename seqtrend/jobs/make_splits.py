"""Normalised observations -> lineage-disjoint FASTA files of training, validation and test sequences.

spark-submit seqtrend/jobs/make_splits.py OBSERVATIONS REFERENCE OUT --until DATE [--blocks 9 1 0] [--since DATE] [--enumerate]
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrend.functions.mutations import apply_mutations
from seqtrend.jobs.common import arguments, session
from seqtrend.operators import series, splits
from seqtrend.sources.fasta import write_fasta
from seqtrend.sources.tables import load_normalised


def run(obs: DataFrame, reference: str, blocks: tuple[int, int, int], until: str | None = None, since: str | None = None, repeat: bool = False, seed: int = 0) -> DataFrame:
    """(m, seq, split): the variants of each split with their sequences; with ``repeat`` as often as they were seen."""
    rows = splits.split_by_lineage(series.date_window(series.usable(obs), end=until), *blocks, seed, since)
    counted = rows.groupBy("split", "m").agg(F.sum("n").alias("n"))
    counted = splits.enumerate_rows(counted) if repeat else counted
    return apply_mutations(counted.select("m", "split"), reference).select("m", "seq", "split")


def main() -> None:
    parser = arguments(__doc__, "observations", "reference", "out")
    parser.add_argument("--until")
    parser.add_argument("--since")
    parser.add_argument("--blocks", type=int, nargs=3, default=(9, 1, 0))
    parser.add_argument("--enumerate", action="store_true")
    a, spark = parser.parse_args(), session("make_splits")
    reference = spark.read.text(a.reference, wholetext=True).first()[0].strip()  # one sequence
    made = run(load_normalised(spark, a.observations, end=a.until), reference, tuple(a.blocks), a.until, a.since, a.enumerate, a.seed)
    for split in ("train", "val", "test"):
        write_fasta(made.where(F.col("split") == split), f"{a.out}/{split}")


if __name__ == "__main__":
    main()
