"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again.

All stages take rows with nulls in any column, empty and very long texts, ties and repeated rows, empty tables
and extra columns of any name but those that start with _llm_ or _k; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqtrend.llm import decontaminate, mixing, near_duplicates as near, sharding, toxicity
from seqtrend.llm.common import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go.

    Null and empty texts are scored like others, and stay with scores below the threshold. Repeated rows and
    rows with a null id are scored one by one. An empty table stays empty.
    """
    return toxicity.clean(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at similarity 0.8 stays; SimHash fingerprints are among the candidates.

    It is that of the smallest id, of which repeats go too; in a group of only null ids that of the smallest
    hash. Null and empty texts are copies of each other. An empty table stays empty.
    """
    return near.keep_one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay. All repeats of a row go or stay, rows with a null id too. An empty
    table, or an empty benchmark, changes nothing.
    """
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that their tokens meet the target shares of sources, languages and topics.

    A null source or language is a value of its own. Repeats of one row are drawn together. Texts without words
    stay where their cell has no tokens, else they are drawn like others. An empty table stays empty.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard.

    Null texts have no bytes, null ids hash as empty, repeats of one row over the limit go to numbered parts.
    An empty table stays empty, with the two columns.
    """
    return sharding.shard(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mix),
    ("sharding", shards),
]

#: Classifier, fingerprints and hashes of stages 1 to 4 are not SQL; tests hold run() against its stages' brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
