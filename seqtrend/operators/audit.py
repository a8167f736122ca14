"""Joins with metadata and reports, and how far assignments agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrend.functions.mutations import apply_mutations, canonical_mutations, verify_sequence
from seqtrend.functions.tokens import made_once


def metadata_join(variants: DataFrame, meta: DataFrame) -> DataFrame:
    """All variants with their metadata by accession, then without those that lack an accession or a virus name."""
    return variants.join(meta, "acc", "left").where("acc is not null and virus_name is not null")


def reassigned(joined: DataFrame, reports: DataFrame) -> DataFrame:
    """``joined`` with the report's lineage (new_lineage), by the virus name before ``|``."""
    by = reports.select(F.col("taxon").alias("_taxon"), F.col("lineage").alias("new_lineage"))
    return joined.join(by, F.substring_index("virus_name", "|", 1) == F.col("_taxon"), "left").drop("_taxon")


def reassignment_audit(joined: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: rows, rows without a result, mismatches where null differs from all, and among rows with both."""
    rows = reassigned(joined, reports)
    same = F.coalesce(F.col("lineage") == F.col("new_lineage"), F.lit(False))
    both = F.col("lineage").isNotNull() & F.col("new_lineage").isNotNull()
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("new_lineage").isNull()).alias("missing"), F.count_if(~same).alias("mismatches"), F.count_if(both & ~same).alias("mismatches_known"))


def minimal_sequences(df: DataFrame, aa: str = "aa") -> DataFrame:
    """(canonical, acc, d): the earliest row of every canonical list of mutations that isn't null."""
    rows = df.where(F.col(aa).isNotNull()).withColumn("canonical", canonical_mutations(aa))
    return rows.groupBy("canonical").agg(F.min(F.struct("d", "acc")).alias("b")).select("canonical", "b.acc", "b.d")


# Fixed value: where a FASTA header holds the accession.
ACCESSION = r"\|EPI_ISL_(\d+)"


def label_reconstruction(obs: DataFrame, fasta: DataFrame, reference: str, fake: bool = False) -> DataFrame:
    """``obs`` with reconstructed: its accession's record exists and agrees with the imputed sequence.

    The imputed sequence is made once per distinct key. ``fake`` sets all true. Several records of one
    accession: one that agrees is enough.
    """
    if fake:
        return obs.withColumn("reconstructed", F.lit(True))
    imputed = apply_mutations(obs.select("m").distinct(), reference)
    found = made_once(fasta, F.regexp_extract("header", ACCESSION, 1), "_acc").where("_acc <> ''")
    # One row per accession: neither the observations nor the records are shuffled by anything else.
    found = found.groupBy("_acc").agg(F.collect_set("sequence").alias("_seen"))  # its different records
    rows = obs.withColumn("_own", F.when(F.startswith("acc", F.lit("EPI_ISL_")), F.substring("acc", 9, 1 << 30)).otherwise(F.col("acc")))
    rows = rows.join(found, F.col("_own") == F.col("_acc"), "left").join(imputed.withColumnRenamed("seq", "_seq"), "m", "left")
    ok = F.coalesce(F.exists("_seen", lambda s: verify_sequence(s, "_seq")), F.lit(False))
    return rows.select(*obs.columns, ok.alias("reconstructed"))
