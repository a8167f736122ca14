"""FASTA text and cluster headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtrend.functions.tokens import made_once
from seqtrend.operators.splits import enumerate_rows
from seqtrend.sources.block_gzip import read_block_gzip

#: Records of one compressed file.
FILE_RECORDS = 1 << 18

# Fixed value: the shape of a cluster's header.
CLUSTER_HEADER = r"^>?(\S+)\s+(.*)\s+n=(\d+)\s+Tax=(.*)\s+TaxID=(\S*)\s+RepID=(\S+)\s*$"


def read_fasta(spark: SparkSession, path: str, header_sep: str | None = None) -> DataFrame:
    """(header, sequence): the first word of the header, or its text before ``header_sep``; joined lines.

    Records without a sequence are left out. One .gz file is one task; a .bgz file, of gzip blocks, has one per split.
    """
    records = read_block_gzip(spark, path, "\n>") if path.endswith(".bgz") else spark.read.text(path, lineSep="\n>")
    # A record is cut into its lines once, not again for its header, its sequence and the filter behind them.
    cut = made_once(records, F.split(F.regexp_replace("value", r"^>", ""), r"\r?\n"), "_lines").select("_lines")
    head = F.get("_lines", F.lit(0))
    head = F.trim(F.substring_index(head, header_sep, 1)) if header_sep else F.regexp_extract(head, r"^\S*", 0)
    body = F.array_join(F.transform(F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0))), lambda x: F.trim(x)), "")
    return made_once(cut, body, "sequence").select(head.alias("header"), "sequence").where("sequence <> ''")


def write_fasta(df: DataFrame, path: str, m: str = "m", seq: str = "seq", numbered: bool = True, compression: str = "none") -> None:
    """``>name`` and sequence; the name of ``""`` is REF, others have _ for commas, with a running number in the name.

    With a ``compression`` (gzip) each file is read by one task, so it has at most FILE_RECORDS records.

    Equal records are counted before they are numbered and dealt again in pieces, so a name that a third of
    all rows has is neither sorted nor written by one task.
    """
    name = F.when(F.col(m) == "", "REF").otherwise(F.replace(F.col(m), F.lit(","), F.lit("_")))
    rows = df.select(name.alias("name"), F.col(seq).alias("seq"))
    if numbered:
        before = Window.partitionBy("name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        counted = rows.groupBy("name", "seq").agg(F.count("*").alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        numbered_rows = enumerate_rows(counted, "_n")
        rows = numbered_rows.select(F.concat_ws("_", "name", (F.col("_at") + F.col("number")).cast("string")).alias("name"), "seq")
    out = rows.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.option("maxRecordsPerFile", 0 if compression == "none" else FILE_RECORDS)
    out.text(path, compression=compression)


def parse_cluster_headers(lines: DataFrame) -> DataFrame:
    """(id, name, size, taxonomy, taxonomy_id, representative) of header lines (column value); a bad one is an error."""
    heads = lines.where(F.col("value").startswith(">"))
    part = lambda i: F.regexp_extract("value", CLUSTER_HEADER, i)
    checked = F.when(F.col("value").rlike(CLUSTER_HEADER), part(1)).otherwise(F.raise_error(F.concat(F.lit("bad header: "), "value")).cast("string"))
    return heads.select(checked.alias("id"), part(2).alias("name"), part(3).cast("long").alias("size"), part(4).alias("taxonomy"), part(5).alias("taxonomy_id"), part(6).alias("representative"))


def read_cluster_headers(spark: SparkSession, path: str) -> DataFrame:
    return parse_cluster_headers(read_block_gzip(spark, path) if path.endswith(".bgz") else spark.read.text(path))


def select_records(fasta: DataFrame, names: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Records whose header, before ``|``, is in ``names``; and the names that no record has."""
    key = F.substring_index("header", "|", 1)
    wanted = names.select(F.col(name).alias("_name")).distinct()
    keyed = fasta.withColumn("_key", key)
    missing = wanted.join(keyed.select(F.col("_key").alias("_name")), "_name", "left_anti").withColumnRenamed("_name", name)
    return keyed.join(wanted, F.col("_key") == F.col("_name"), "left_semi").drop("_key"), missing
