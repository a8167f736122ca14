"""Global ranks without a single-task window, and rules that cut ranked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrend.functions.rand import rand_key


def global_rank(df: DataFrame, group: list[Column], order: list[Column], name: str = "rn", within: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """``df`` with its row number, from 1, by (group, order), of all rows or of those with equal ``within``.

    Rows are numbered inside each value of the group; the groups' offsets are running sums over one row per
    group. So no task needs all rows: the group has to be fine enough, which ``spread`` sees to. With ``most`` only
    the rows up to that number: other groups' rows are left where they are, neither shuffled nor sorted. Groups and
    values of ``within`` have to be few then, as the groups that are kept are broadcast.
    """
    marks = [f"_g{i}" for i in range(len(group))]
    keyed = df.withColumns(dict(zip(marks, group)))
    sizes = keyed.groupBy(*within, *marks).agg(F.count("*").alias("_n"))
    along = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(*marks)
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*within, *marks, before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(*within, *marks).orderBy(*order))
    if most is not None:
        some = keyed.join(F.broadcast(offsets.where(F.col("_before") < most)), [*within, *marks])
        return some.select(*df.columns, (place + F.col("_before")).alias(name)).where(F.col(name) <= most)
    return keyed.withColumn("_in_group", place).join(offsets, [*within, *marks]).select(*df.columns, (F.col("_in_group") + F.col("_before")).alias(name))


def spread(key: Column, bits: int = 8) -> Column:
    """The top bits of a random key (of 60): cuts a group into 2**bits parts, in the order of the key."""
    return F.shiftright(key, 60 - bits)


def prefix_sums(df: DataFrame, within: str, segment: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums, named by ``sums``, by (segment, order) of the rows with equal ``within``.

    Sums run inside each segment, and what the segments before it sum up to is added, from one row a segment:
    a run of any size is summed up in many tasks. Rows of equal order belong into one segment.
    """
    names = [f"_v{i}" for i in range(len(sums))]
    rows = df.withColumn("_segment", segment).withColumns(dict(zip(names, sums.values())))
    totals = rows.groupBy(within, "_segment").agg(*[F.sum(v).alias(v) for v in names])
    before = Window.partitionBy(within).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(within, "_segment", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before{v}") for v in names])
    along = Window.partitionBy(within, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [(F.sum(v).over(along) + F.col(f"_before{v}")).alias(name) for name, v in zip(sums, names)]
    return rows.join(offsets, [within, "_segment"]).select(*df.columns, *out)


def random_rank(df: DataFrame, seed: int | str, keys: list[str], name: str = "rn", within: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Row number in a random order, of all rows or of those with equal ``within``; equal rows are ranked as they come."""
    key = rand_key(seed, *keys)
    return global_rank(df, [spread(key, 12)], [key, *map(F.col, keys)], name, within, most)


def balanced_cuts(scores: DataFrame, column: str, parts: int = 128) -> list[float]:
    """At most ``parts`` - 1 ascending values that cut a column into parts of about equal size, from a bounded sketch."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = scores.agg(F.percentile_approx(column, shares, F.lit(10 * parts)).alias("c")).first()["c"]  # parts - 1 values
    return sorted(set(found or []))


def above_cuts(column: Column | str, cuts: list[float]) -> Column:
    """How many of the cuts are no larger than the value: rises with it, so it can be a group of ``global_rank``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]).cast("array<double>"), lambda x: x <= c))


def split_by_rank_blocks(df: DataFrame, n_train: int, n_val: int, n_test: int, seed: int, total: str = "total", key: str = "m") -> DataFrame:
    """``df`` with split: blocks of consecutive ranks by total (descending), each dealt at random.

    Ties of a total are ordered by a random key, so that the many variants of total 1 are ranked in many
    tasks. The first n_train of a shuffled block are train, the next n_val val, the rest test. With n_test = 0
    the last n_val of every block are val, also of a short last one.
    """
    if n_test == 0 and n_val == 0:
        raise ValueError("no val and no test part")
    size = n_train + n_val + n_test
    tie = rand_key(f"{seed}-ties", key)
    ranked = global_rank(df, [-F.col(total), spread(tie)], [tie, F.col(key)]).withColumn("_block", F.floor((F.col("rn") - 1) / size))
    block = Window.partitionBy("_block")
    ranked = ranked.withColumn("_at", F.row_number().over(block.orderBy(rand_key(seed, key), key)))
    if n_test:
        split = F.when(F.col("_at") <= n_train, "train").when(F.col("_at") <= n_train + n_val, "val").otherwise("test")
    else:
        ranked = ranked.withColumn("_size", F.count("*").over(block))
        split = F.when(F.col("_at") > F.col("_size") - n_val, "val").otherwise("train")
    return ranked.withColumn("split", split).drop("rn", "_block", "_at", "_size")


def apply_precomputed_split(df: DataFrame, train: DataFrame, val: DataFrame, test: DataFrame, key: str = "m") -> DataFrame:
    """``df`` with split by three lists of keys; train wins over val over test, other keys are dropped."""
    parts = [t.select(F.col(key).alias("_key"), F.lit(i).alias("_p")) for i, t in enumerate((train, val, test))]
    given = parts[0].union(parts[1]).union(parts[2]).groupBy("_key").agg(F.min("_p").alias("_p"))
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("_p") + 1)
    return df.join(given, F.col(key) == F.col("_key")).withColumn("split", split).drop("_key", "_p")


def stratified_sample(df: DataFrame, stratum: str, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows without replacement, strata in turn while they last.

    What the largest stratum has beyond the second largest is never drawn; a lone stratum is sampled plainly.
    """
    ranked = random_rank(df, seed, keys, "_rn", (stratum,)).withColumn("_key", rand_key(seed, *keys))
    sizes = df.groupBy(stratum).count().orderBy(F.desc("count")).limit(2).agg(F.min("count").alias("_most"))  # one row
    rows = ranked.join(F.broadcast(sizes)).where(F.col("_rn") <= F.col("_most"))
    return rows.orderBy("_rn", "_key", *keys).limit(n).drop("_key", "_rn", "_most")
