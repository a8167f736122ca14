"""Observation tables, samples, generations, reports, pairs, examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqtrend.functions.dates import parse_date
from seqtrend.functions.mutations import extract_mutations
from seqtrend.functions.rand import rand_key
from seqtrend.operators.ranks import random_rank
from seqtrend.operators.series import date_window

# The columns of a raw table, the spellings of the host, what stands for a missing value.
RAW = ("Accession ID", "Virus name", "Host", "Location", "Submission date", "Collection date", "Pango lineage", "AA Substitutions")
HUMAN = ("Human", "human")
MISSING = ("", "NA", "N/A", "NULL", "null", "NaN", "nan", "None", "n/a", "<NA>", "#N/A")
PAIR = "seq0 string, count0 double, seq1 string, count1 double, period int, weekly_counts0 array<double>, weekly_counts1 array<double>"
NORMALISED = "acc string, virus_name string, location string, lineage string, d date, m string, month string"
NESTED = "orig_sequence string, generations array<array<struct<parent:string,child:string,ll:double,ll_ratio:double,metric:double,parent_mutation_repr:string,child_mutation_repr:string,potential:double>>>"


def _known(c: str):
    return F.when(~F.col(c).isin(*MISSING), F.col(c))


def read_observations(spark: SparkSession, path: str, hosts: tuple[str, ...] = HUMAN, max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of these hosts from a tab-separated table, all text; optionally a random sample of max_rows."""
    rows = spark.read.csv(path, sep="\t", header=True, enforceSchema=False, schema=T.StructType([T.StructField(c, T.StringType()) for c in RAW]))
    rows = rows.where(F.col("Host").isin(*hosts))
    return rows if max_rows is None else rows.orderBy(rand_key(seed, *RAW)).limit(max_rows)


def normalise(raw: DataFrame, datefield: str = "Submission date", protein: str = "Spike") -> DataFrame:
    """(acc, virus_name, location, lineage, d, m): rows with a lineage; a missing list of mutations is ``""``."""
    names = ["Accession ID", "Virus name", "Location", "Pango lineage"]
    rows = raw.select(*[_known(n).alias(a) for n, a in zip(names, ("acc", "virus_name", "location", "lineage"))], parse_date(_known(datefield)).alias("d"), extract_mutations(_known("AA Substitutions"), protein).alias("m"))
    return rows.where("lineage is not null")


def _by_month(df: DataFrame) -> DataFrame:
    rows = df.withColumn("month", F.date_format("d", "yyyy-MM"))
    return rows.repartition("month", F.pmod(F.xxhash64("acc"), F.lit(8)))


def write_normalised(df: DataFrame, path: str) -> None:
    """Parquet by month; ``load_normalised`` with a range reads only its months. A null date has a folder of its own.

    Rows of a month are brought together first, in as many parts as their hash gives: few files per folder.
    """
    _by_month(df).write.partitionBy("month").parquet(path)


def month_digests(df: DataFrame) -> DataFrame:
    """(month, n, digest) of normalised rows: rows and the sum of their hashes, whatever their order."""
    columns = [c for c in df.columns if c != "month"]
    return df.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))


def refresh_normalised(df: DataFrame, path: str) -> DataFrame:
    """Bring a stored table to the new snapshot ``df``, with the columns that were stored, and return the (month, change) that differed.

    Only months whose rows changed are written, as whole folders; those that the snapshot no longer has are removed
    (change: written or removed). Other folders keep their files. ``df`` must not read from ``path``. A run that
    is cut off can be repeated: what it has written is then found equal.
    """
    spark = df.sparkSession
    held = spark.read.schema(T.StructType([*df.drop("month").schema.fields, T.StructField("month", T.StringType())])).parquet(path)
    old = month_digests(held.drop("month")).toDF("month", "_n", "_digest").withColumn("_old", F.lit(True))
    new = month_digests(df).withColumn("_new", F.lit(True))
    both = new.join(old, new["month"].eqNullSafe(old["month"]), "full")
    same = F.coalesce((F.col("n") == F.col("_n")) & (F.col("digest") == F.col("_digest")), F.lit(False))
    changed = both.where(~same).select(F.coalesce(new["month"], old["month"]).alias("month"), F.when(F.col("_new"), "written").otherwise("removed").alias("change"))
    changed = spark.createDataFrame(changed.collect(), "month string, change string")  # a row a month
    months = F.broadcast(changed.where("change = 'written'").select(F.col("month").alias("_month")))
    rows = df.join(months, F.date_format("d", "yyyy-MM").eqNullSafe(F.col("_month")), "left_semi")
    _by_month(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in changed.where("change = 'removed'").collect():
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/month={r.month or '__HIVE_DEFAULT_PARTITION__'}")
        folder.getFileSystem(conf).delete(folder, True)
    return changed


def load_normalised(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, labelled: bool = False) -> DataFrame:
    """The stored table, or its rows from ``start`` to ``end``, of which only the months' folders are read.

    ``labelled``: with the column reconstructed, null where the table was stored without it.
    """
    rows = spark.read.schema("reconstructed boolean, " + NORMALISED if labelled else NORMALISED).parquet(path)
    return date_window(rows, start, end).drop("month")


def export_accessions(df: DataFrame, path: str) -> None:
    df.select(F.col("acc").cast("string")).write.text(path)


def read_samples(spark: SparkSession, paths: str | list[str], score: str = "ll", level: int = -1) -> DataFrame:
    """(run, seq, score) of JSON lines; run is the file's name, or with ``level`` -2 that of its folder."""
    rows = spark.read.schema(f"seq string, {score} double").json(paths)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), level).alias("run"), "seq", F.col(score).alias("score"))


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """One row per candidate: orig, generation (from 1), rank, parent, child, scores; the root's generation is skipped."""
    rows = spark.read.schema(NESTED).json(path).select("orig_sequence", F.posexplode("generations").alias("generation", "_g")).where("generation > 0")
    return rows.select("orig_sequence", "generation", F.posexplode("_g").alias("rank", "_c")).select("orig_sequence", "generation", "rank", "_c.*")


def last_reports(rows: DataFrame) -> DataFrame:
    """One row per taxon: the last by (file, row)."""
    return rows.groupBy("taxon").agg(F.max_by("lineage", F.struct("file", "row")).alias("lineage"))


def read_assignment_reports(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, lineage) of all CSV reports below the folder, the last row of a taxon by file path and place."""
    rows = spark.read.option("recursiveFileLookup", True).csv(path, header=True, pathGlobFilter="*.csv", schema="taxon string, lineage string", enforceSchema=False)
    return last_reports(rows.select("taxon", "lineage", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")))


def read_pairs(spark: SparkSession, path: str, min_max: float | None = None, min_min: float | None = None) -> DataFrame:
    return filter_pairs(spark.read.schema(PAIR).json(path), min_max, min_min)


def filter_pairs(pairs: DataFrame, min_max: float | None = None, min_min: float | None = None) -> DataFrame:
    """Pairs without ``stop`` whose larger (smaller) count reaches the floor."""
    out = pairs.where(~F.col("seq0").contains("stop") & ~F.col("seq1").contains("stop"))
    out = out if min_max is None else out.where(F.greatest("count0", "count1") >= min_max)
    return out if min_min is None else out.where(F.least("count0", "count1") >= min_min)


def cap_rows(df: DataFrame, n: int, seed: int, by: str, keys: list[str]) -> DataFrame:
    """At most n random rows per value of ``by``, which are few: ranked in parts of the random key, so also where one value
    has most rows, and only in the parts that the first n are in."""
    return random_rank(df, seed, keys, "_rn", (by,), n).select(*df.columns)


def write_pairs(pairs: DataFrame, path: str, max_rows: int | None = None, seed: int = 0) -> None:
    """JSON lines per split, optionally at most max_rows of each at random."""
    pairs = pairs if max_rows is None else cap_rows(pairs, max_rows, seed, "split", ["seq0", "seq1"])
    pairs.write.partitionBy("split").json(path)


def write_examples(examples: DataFrame, path: str) -> DataFrame:
    """Token examples by data_type; returns the counts."""
    examples.write.partitionBy("data_type").parquet(path)
    return examples.sparkSession.read.parquet(path).groupBy("data_type").count()
