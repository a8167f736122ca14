"""Training, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrend.functions.rand import rand_key, rand_share
from seqtrend.operators.ranks import global_rank, random_rank
from seqtrend.operators.series import date_window

#: Numbers that one task writes out for one row at a time.
CHUNK = 100_000


def split_by_lineage(df: DataFrame, n_train: int, n_val: int, n_test: int, seed: int = 0, first_date: str | None = None) -> DataFrame:
    """(m, lineage, n, split): lineages in blocks by count, dealt at random; a variant of a train lineage is train's alone.

    Train comes first in every block, then val; with n_test = 0 the rest of a block is test all the same.
    ``first_date``: only variants that were seen on that day or later.
    """
    lineages = df.groupBy("lineage").agg(F.count("*").alias("total"))
    size = n_train + n_val + n_test
    ranked = global_rank(lineages, [-F.col("total")], [F.col("lineage").desc()])
    ranked = ranked.withColumn("_at", F.row_number().over(Window.partitionBy(F.floor((F.col("rn") - 1) / size)).orderBy(rand_key(seed, "lineage"), "lineage")))
    part = F.when(F.col("_at") <= n_train, "train").when(F.col("_at") <= n_train + n_val, "val").otherwise("test")
    counted = df.groupBy("m", "lineage").agg(F.count("*").alias("n"), F.max("d").alias("_last"))
    rows = counted.join(ranked.select("lineage", part.alias("split")), "lineage")
    train = rows.where("split = 'train'").select("m").distinct()
    rows = rows.where("split = 'train'").unionByName(rows.where("split <> 'train'").join(train, "m", "left_anti"))
    rows = rows if first_date is None else rows.where(F.col("_last") >= F.lit(first_date).cast("date"))
    return rows.select("m", "lineage", "n", "split")


def enumerate_rows(df: DataFrame, n: str = "n") -> DataFrame:
    """Every row as often as its count, with its number from 0; nothing for a count of 0.

    A row is dealt as pieces of CHUNK first, so a very frequent one is written out in many tasks.
    """
    last = (F.col(n) - 1).cast("int")
    # By number: pieces are few bytes but make many rows, and an adaptive plan would give them to one task.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = df.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0), last, F.lit(CHUNK))).alias("_from")).repartition(parts, *df.columns, "_from")
    return pieces.select("*", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (CHUNK - 1), last))).alias("number")).drop("_from")


def date_split(df: DataFrame, train_end: str, val_end: str) -> DataFrame:
    """(m, lineage, split): train up to its date; val the later ones up to its date whose variant isn't in train."""
    train = date_window(df, end=train_end).select("m", "lineage").distinct()
    val = date_window(date_window(df, start=train_end, closed="neither"), end=val_end).select("m", "lineage").distinct()
    val = val.join(train.select("m").distinct(), "m", "left_anti")
    return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))


def lineage_split(df: DataFrame, frac: float, seed: int = 0, disjoint: bool = False) -> DataFrame:
    """(m, lineage, split): random lineages; val gets ceil(n (1 - frac)) of them, one at least.

    A variant of several lineages may be in both; ``disjoint`` takes it from val.
    """
    ranked = random_rank(df.select("lineage").distinct(), seed, ["lineage"])
    sizes = ranked.agg(F.greatest(F.lit(1), F.ceil(F.round(F.count("*") * (1 - frac), 9))).alias("_val"))
    lineages = ranked.join(F.broadcast(sizes)).select("lineage", F.when(F.col("rn") <= F.col("_val"), "val").otherwise("train").alias("split"))
    rows = df.select("m", "lineage").distinct().join(lineages, "lineage").select("m", "lineage", "split")
    if not disjoint:
        return rows
    train = rows.where("split = 'train'").select("m").distinct()
    return rows.where("split = 'train'").unionByName(rows.where("split = 'val'").join(train, "m", "left_anti"))


def by_shares(x: Column, shares: list[float], names: list[str]) -> Column:
    """The name whose cumulative share x (in [0, 1)) falls into; the last takes the rest."""
    out, upper = F.lit(names[-1]), sum(shares[:-1])
    for share, name in zip(reversed(shares[:-1]), reversed(names[:-1])):
        out = F.when(x < F.lit(float(upper)), F.lit(name)).otherwise(out)
        upper -= share
    return out


def cluster_bucket(cluster: str, buckets: int = 10_000) -> Column:
    """The last 8 hex digits of the name's SHA-256, modulo the number of buckets."""
    return F.conv(F.right(F.sha2(cluster, 256), F.lit(8)), 16, 10).cast("long") % buckets


def hash_cluster_split(ids: DataFrame, clusters: DataFrame, weights: list[float], names: list[str], buckets: int = 10_000) -> DataFrame:
    """(id, cluster, split): by the cluster's bucket against cumulative whole shares; an id without a cluster is dropped."""
    bounds, total, upper = [], sum(weights), 0
    for w in weights[:-1]:
        upper += int(w * buckets / total + 1e-9)
        bounds.append(upper)
    bucket, split = cluster_bucket("cluster", buckets), F.lit(names[-1])
    for bound, name in zip(reversed(bounds), reversed(names[:-1])):
        split = F.when(bucket < bound, F.lit(name)).otherwise(split)
    return ids.select("id").join(clusters, "id").select("id", "cluster", split.alias("split"))


def random_cluster_split(headers: DataFrame, train: float, val: float, seed: int = 0) -> DataFrame:
    """(id, name, split) by distinct cluster names in exact sizes: train rounded up, val down, test the rest."""
    ranked = random_rank(headers.select("name").distinct(), seed, ["name"])
    sizes = ranked.agg(F.ceil(F.count("*") * train).alias("_t"), F.floor(F.count("*") * val).alias("_v"))
    split = F.when(F.col("rn") <= F.col("_t"), "train").when(F.col("rn") <= F.col("_t") + F.col("_v"), "val").otherwise("test")
    return headers.select("id", "name").join(ranked.join(F.broadcast(sizes)).select("name", split.alias("split")), "name").select("id", "name", "split")


def random_record_split(df: DataFrame, shares: list[float], names: list[str], keys: list[str], seed: int = 0) -> DataFrame:
    """``df`` with split, each record by itself."""
    return df.withColumn("split", by_shares(rand_share(seed, *keys), shares, names))


def explicit_split(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """The ids with the split of the map; unknown ones are dropped."""
    return ids.join(mapping.select("id", "split"), "id")


def new_vs_old(df: DataFrame, cutoff: str, by_first_seen: bool = True) -> DataFrame:
    """(m, age): old up to the date, new after it; by row a variant may be both, by first sighting only one."""
    age = F.when(F.col("d") <= F.lit(cutoff).cast("date"), "old").otherwise("new")
    rows = df.groupBy("m").agg(F.min("d").alias("d")) if by_first_seen else df
    return rows.select("m", age.alias("age")).distinct()

