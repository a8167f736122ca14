"""A stored index of known k-mers, made once and used by every later run.

It has two parts: all known k-mers in a table bucketed by k-mer, which a join reads without a shuffle, and a
filter of bits small enough to broadcast. A sample's k-mer whose bit isn't set is new without a look at the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.operators.evaluate import kmers
from seqtrend.sources.scratch import stored

#: Bits of the filter per known k-mer, and its most bits, as a power of two (2**30 bits are 128 MB).
BITS_PER_KMER, LEAST_POWER, MOST_POWER = 16, 15, 30
#: Words of 64 bits in a part of the filter (a part is what the bitmap functions call a bucket).
WORDS = 512


@dataclass(frozen=True)
class KmerIndex:
    """Where an index is: its table in the catalog, its filter's folder and bits (as a power of two), its k."""

    table: str
    filter_path: str
    power: int
    k: int


def _bit(kmer: str, power: int) -> Column:
    """The bit of a k-mer, from 1, as the bitmap functions count."""
    return F.pmod(F.xxhash64(kmer), F.lit(1 << power)) + 1


def write_kmer_index(known: DataFrame, table: str, path: str, k: int = 11, buckets: int | None = None) -> KmerIndex:
    """Store the k-mers of known sequences (column seq) as ``table``, with its files and the filter below ``path``.

    ``buckets`` should be the shuffle partitions of the runs that use it, which is the default.
    """
    spark = known.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = kmers(known.select("seq").where("seq is not null").distinct(), k).distinct()
    # Dealt as the buckets are, so that each is one file.
    seen.repartition(buckets, "kmer").write.bucketBy(buckets, "kmer").sortBy("kmer").option("path", f"{path}/kmers").mode("overwrite").saveAsTable(table)
    rows = spark.table(table)
    power = min(MOST_POWER, max(LEAST_POWER, math.ceil(math.log2(max(1, rows.count()) * BITS_PER_KMER))))
    bit = _bit("kmer", power)
    at = F.bitmap_bit_position(bit)
    words = rows.groupBy(F.bitmap_bucket_number(bit).alias("part"), F.floor(at / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))).alias("w"))
    # At most WORDS a part; as an array a look at one of them copies nothing.
    held = words.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("_m"))
    bits = held.select("part", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0).cast("long"))).alias("bits"))
    bits.write.mode("overwrite").parquet(f"{path}/filter")
    return KmerIndex(table, f"{path}/filter", power, k)


def _is_set(bits: Column, place: Column) -> Column:
    """Whether the bit at ``place`` (from 0, lowest of a word first) is set; null bits have none."""
    word = F.get(bits, F.floor(place / 64).cast("int"))
    return F.coalesce(F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def indexed_novelty(samples: DataFrame, index: KmerIndex) -> DataFrame:
    """(seq, novelty) per distinct sample: at how many places its k-mer is not in the index.

    The filter is broadcast: it has at most 2**MOST_POWER bits. Only k-mers whose bit is set are shuffled, to the
    buckets of the index, which is not shuffled itself. A null sample is left out.
    """
    spark = samples.sparkSession
    distinct = samples.where("seq is not null").select("seq").distinct().withColumn("_id", F.unhex(F.md5(F.col("seq").cast("binary"))))
    distinct = stored(distinct, "sequences")
    bit = _bit("kmer", index.power)
    rows = kmers(distinct, index.k, "_id").select("_id", "kmer", F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("_at"))
    rows = rows.join(F.broadcast(spark.read.parquet(index.filter_path)), "part", "left").select("_id", "kmer", _is_set(F.col("bits"), F.col("_at")).alias("_set"))
    # One look at every k-mer: those whose bit isn't set are counted together, under null.
    counts = stored(rows.groupBy("_id", F.when(F.col("_set"), F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n")), "counts")
    new = counts.where("kmer is null").select("_id", "n")
    asked = counts.where("kmer is not null")
    left = asked.join(spark.table(index.table).hint("merge"), "kmer", "left_anti").groupBy("_id").agg(F.sum("n").alias("n"))
    fresh = new.union(left).groupBy("_id").agg(F.sum("n").alias("novelty"))
    return distinct.join(fresh, "_id", "left").select("seq", F.coalesce("novelty", F.lit(0)).alias("novelty"))
