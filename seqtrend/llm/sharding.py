"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, split only where a bucket is too large."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtrend.llm.common import BROADCAST_ROWS, join_counted, small, stored

BITS = 60
LIMIT_BYTES = 32 << 20
#: Of the query, so that also the small tables are split.
QUERY_LIMIT_BYTES = 1 << 18
STEP = 8


def hash60() -> Column:
    """First 60 bits of the MD5 of id and text: rows that differ in either part ways at some bit."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def text_bytes() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.shiftrightunsigned(h, BITS - depth) if isinstance(depth, int) else F.call_function("shiftright", h, F.lit(BITS) - depth)


def _split(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Nodes (depth, prefix, bytes, n, full) of depths low to high over rows (h, bytes)."""
    cells = rows.groupBy(_prefix(F.col("h"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    nodes = cells.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "cell", "bytes", "n")
    nodes = nodes.groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")).alias("prefix"))
    nodes = nodes.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    return nodes.withColumn("full", (F.col("bytes") > limit) & (F.col("n") > 1))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """The shards: (depth, prefix, bytes, n, full) of every leaf, from rows (h, bytes).

    A bucket splits on its next bit while it has more than ``limit`` bytes and more than one row. A leaf is
    ``full`` only at the last bit: its rows have one hash, so they are repeats.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, STEP + max(0, math.ceil(math.log2(max(1, total / limit)))))
    leaves, active = None, rows
    while True:
        nodes = stored(_split(active, low, high, limit), "buckets")
        above = nodes.where("full").select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        reached = nodes.where(F.col("depth") > low).join(above, ["depth", "prefix"], "left_semi")
        top = nodes.where(F.col("depth") == low)
        # Below the first range the top nodes are halves of buckets that were full.
        done = reached.union(top).where(f"not full or depth = {BITS}")
        leaves = done if leaves is None else leaves.union(done)
        oversize = reached.union(top).where(f"full and depth = {high}").select(F.col("prefix").alias("_cell"))
        if high == BITS or oversize.isEmpty():
            return stored(leaves, "directory")
        active = stored(active.join(small(oversize), _prefix(F.col("h"), high) == F.col("_cell"), "left_semi"), "oversized")
        low, high = high + 1, min(BITS, high + STEP)


def assign(docs: DataFrame, leaves: DataFrame, limit: int = LIMIT_BYTES, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with shard_id (1 bits prefix, as a number) and shard_part (0 but for repeats over the limit).

    A directory of up to ``most`` leaves is broadcast, with one join per depth that occurs (at most 61). A larger one
    meets the hashes alone, each at the depths that occur, and the texts are joined with their hash's shard once.
    """
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]
    out = docs.withColumn("_llm_h", hash60())
    if leaves.count() <= most:
        out = out.withColumn("shard_id", F.lit(None).cast("long"))
        for d in depths:
            part = F.broadcast(leaves.where(F.col("depth") == d).select(F.col("prefix").alias("_llm_prefix")))
            out = out.join(part, _prefix(F.col("_llm_h"), d) == F.col("_llm_prefix"), "left")
            out = out.withColumn("shard_id", F.coalesce("shard_id", F.when(F.col("_llm_prefix").isNotNull(), F.col("_llm_prefix") + F.lit(1 << d)))).drop("_llm_prefix")
    else:
        tries = out.groupBy("_llm_h").agg(F.count("*").alias("n"))
        tries = tries.select("_llm_h", "n", F.explode(F.array(*map(F.lit, depths))).alias("depth")).withColumn("prefix", _prefix(F.col("_llm_h"), F.col("depth")))
        shard_id = F.col("prefix") + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))
        found = stored(tries.join(leaves.select("depth", "prefix"), ["depth", "prefix"]).select("_llm_h", "n", shard_id.alias("shard_id")), "shards")
        out = join_counted(out, found, ["_llm_h"]).drop("n")
        out = out.select(*docs.columns, "_llm_h", "shard_id")
    full = leaves.where("full").select(F.col("prefix").alias("_llm_h"))
    if full.isEmpty():
        return out.withColumn("shard_part", F.lit(0).cast("long")).drop("_llm_h")
    return _parts(out, small(full), limit).drop("_llm_h")


def _parts(docs: DataFrame, full: DataFrame, limit: int) -> DataFrame:
    """Repeats (rows of one hash) over the limit: numbered per input partition and dealt to parts in order."""
    repeats = docs.join(full, "_llm_h", "left_semi").withColumn("_llm_pid", F.spark_partition_id())
    repeats = repeats.withColumn("_llm_rn", F.row_number().over(Window.partitionBy("_llm_h", "_llm_pid").orderBy("_llm_pid")))
    repeats = stored(repeats, "repeats")
    sizes = repeats.groupBy("_llm_h", "_llm_pid").agg(F.count("*").alias("_llm_n"))
    before = Window.partitionBy("_llm_h").orderBy("_llm_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = small(sizes.select("_llm_h", "_llm_pid", F.coalesce(F.sum("_llm_n").over(before), F.lit(0)).alias("_llm_before")))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / text_bytes()))
    dealt = repeats.join(sizes, ["_llm_h", "_llm_pid"]).withColumn("shard_part", F.floor((F.col("_llm_rn") + F.col("_llm_before") - 1) / room).cast("long"))
    rest = docs.join(full, "_llm_h", "left_anti").withColumn("shard_part", F.lit(0).cast("long"))
    return rest.unionByName(dealt.select(rest.columns))


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` with shard_id and shard_part; no (shard_id, shard_part) has over ``limit`` bytes of text unless it is one document.

    Null texts count 0 bytes and null ids hash as empty. Columns named shard_id or shard_part are replaced.
    An empty table stays empty. Repeats of one row that exceed the limit together go to numbered parts.
    """
    docs = docs.drop("shard_id", "shard_part")
    rows = stored(docs.select(hash60().alias("h"), text_bytes().alias("bytes")), "hashes")
    return assign(docs, directory(rows, limit), limit)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write one folder per shard."""
    shard(docs, limit).repartition("shard_id", "shard_part").write.partitionBy("shard_id", "shard_part").parquet(path)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard(docs, QUERY_LIMIT_BYTES)
    return out.select("doc_id", "shard_id", "shard_part", text_bytes().alias("n_bytes"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
depths AS (SELECT unnest(range(0, {BITS + 1})) AS depth),
nodes AS (
  SELECT depth, h >> ({BITS} - depth) AS prefix, sum(n_bytes) AS b, count(*) AS n FROM d, depths GROUP BY ALL),
leaf AS (
  SELECT d.doc_id, d.h, min(nodes.depth) AS depth
  FROM d JOIN nodes ON d.h >> ({BITS} - nodes.depth) = nodes.prefix
  WHERE nodes.b <= {QUERY_LIMIT_BYTES} OR nodes.n = 1 GROUP BY ALL)
SELECT d.doc_id, CAST((1::BIGINT << leaf.depth) + (d.h >> ({BITS} - leaf.depth)) AS BIGINT) AS shard_id,
       CAST(0 AS BIGINT) AS shard_part, CAST(d.n_bytes AS BIGINT) AS n_bytes
FROM d JOIN leaf USING (doc_id, h)
"""
