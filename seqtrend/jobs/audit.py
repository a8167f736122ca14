"""Variants, metadata and assignment reports -> how many lineages were assigned anew, and the records of the minimal set.

spark-submit seqtrend/jobs/audit.py VARIANTS METADATA REPORTS OUT
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqtrend.jobs.common import arguments, session
from seqtrend.operators import audit
from seqtrend.sources.tables import read_assignment_reports


def run(variants: DataFrame, metadata: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The audit's one row, and the variants with their old and new lineages."""
    joined = audit.metadata_join(variants, metadata)
    return audit.reassignment_audit(joined, reports), audit.reassigned(joined, reports)


def main() -> None:
    a, spark = arguments(__doc__, "variants", "metadata", "reports", "out").parse_args(), session("audit")
    counts, rows = run(spark.read.parquet(a.variants), spark.read.parquet(a.metadata), read_assignment_reports(spark, a.reports))
    counts.write.json(f"{a.out}/counts")
    rows.write.parquet(f"{a.out}/rows")


if __name__ == "__main__":
    main()
