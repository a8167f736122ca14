"""FASTA and clusters -> token examples by split: cluster hash, chunks, masked examples.

spark-submit seqtrend/jobs/make_corpus.py FASTA CLUSTERS OUT [--weights 0.98 0.01 0.01] [--length 1022]
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrend.functions.tokens import chunk_sequence, letter_ids, mask_at, masked_places
from seqtrend.jobs.common import arguments, session
from seqtrend.operators.splits import hash_cluster_split
from seqtrend.sources.clusters import cluster_members, read_cluster_xml
from seqtrend.sources.fasta import read_fasta
from seqtrend.sources.tables import write_examples


def run(records: DataFrame, clusters: DataFrame, weights: list[float], length: int = 1022, seed: int = 0) -> DataFrame:
    """(id, fragment, data_type, ids, mask_start, mask_length, encoder, decoder) of records (id, seq) that a cluster has."""
    placed = hash_cluster_split(records.select("id"), clusters, weights, ["train", "val", "test"]).select("id", F.col("split").alias("data_type"))
    pieces = chunk_sequence(records.join(placed, "id"), length).select("id", "fragment", "data_type", "piece")
    # In the order in which files by split are written, while the rows are narrow: examples are many times as wide.
    made = masked_places(pieces, seed, seq="piece").sortWithinPartitions("data_type")
    example = mask_at("piece", F.col("mask_start"), F.col("mask_length"))
    return made.select("id", "fragment", "data_type", letter_ids("piece").alias("ids"), "mask_start", "mask_length", example["encoder"].alias("encoder"), example["decoder"].alias("decoder"))


def main() -> None:
    parser = arguments(__doc__, "fasta", "clusters", "out")
    parser.add_argument("--weights", type=float, nargs=3, default=(0.98, 0.01, 0.01))
    parser.add_argument("--length", type=int, default=1022)
    a, spark = parser.parse_args(), session("make_corpus")
    records = read_fasta(spark, a.fasta).select(F.col("header").alias("id"), F.col("sequence").alias("seq"))
    write_examples(run(records, cluster_members(read_cluster_xml(spark, a.clusters)), list(a.weights), a.length, a.seed), a.out).show()


if __name__ == "__main__":
    main()
