"""Raw table -> normalised observations by month, with the label of reconstruction where records are given.

spark-submit seqtrend/jobs/normalise.py RAW OUT [--fasta F --reference R | --fake] [--refresh] [--datefield D] [--protein P]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqtrend.jobs.common import arguments, session
from seqtrend.operators.audit import label_reconstruction
from seqtrend.sources.fasta import read_fasta
from seqtrend.sources.scratch import scratch_tables, stored
from seqtrend.sources.tables import load_normalised, normalise, read_observations, refresh_normalised, write_normalised


def run(
    spark: SparkSession, raw: str, out: str, fasta: DataFrame | None = None, reference: str | None = None, datefield: str = "Submission date", protein: str = "Spike", fake: bool = False, refresh: bool = False
) -> DataFrame:
    """The stored table; with records (or ``fake``) it has the column reconstructed, for later jobs to go by.

    ``refresh``: ``out`` holds an earlier snapshot, of which only the months that changed are written.
    """
    rows = normalise(read_observations(spark, raw), datefield, protein)
    labelled = fasta is not None or fake
    if labelled:
        rows = stored(label_reconstruction(rows, fasta, reference, fake), "labelled")
    if refresh:
        refresh_normalised(rows, out)
    else:
        write_normalised(rows, out)
    return load_normalised(spark, out, labelled=labelled)


def main(argv: list[str] | None = None) -> None:
    parser = arguments(__doc__, "raw", "out")
    parser.add_argument("--fasta")
    parser.add_argument("--reference", help="text file with the reference sequence")
    parser.add_argument("--fake", action="store_true", help="label all rows as reconstructed")
    parser.add_argument("--refresh", action="store_true")
    parser.add_argument("--datefield", default="Submission date")
    parser.add_argument("--protein", default="Spike")
    a, spark = parser.parse_args(argv), session("normalise")
    reference = spark.read.text(a.reference, wholetext=True).first()[0].strip() if a.reference else None  # one sequence
    with scratch_tables(spark):
        run(spark, a.raw, a.out, read_fasta(spark, a.fasta) if a.fasta else None, reference, a.datefield, a.protein, a.fake, a.refresh)


if __name__ == "__main__":
    main()
