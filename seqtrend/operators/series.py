"""Filters, first sightings, counts and weekly series of observations (acc, location, lineage, d, m)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqtrend.functions.dates import week_index
from seqtrend.functions.mutations import apply_mutations
from seqtrend.functions.rand import rand_key


def date_window(df: DataFrame, start: str | date | None = None, end: str | date | None = None, closed: str = "both") -> DataFrame:
    """Rows in a range of dates; ``closed``: both, left, right or neither.

    A table with a column month (yyyy-MM), as ``write_normalised`` partitions by, is cut by it too, so that folders
    outside of the range aren't read.
    """
    d = F.col("d")
    if "month" in df.columns:
        months = [(start, ">="), (end, "<=")]
        for day, side in months:
            if day is not None:
                df = df.where(F.expr(f"month {side} date_format(date'{day}', 'yyyy-MM')"))
    if start is not None:
        df = df.where(d >= F.lit(start).cast("date") if closed in ("both", "left") else d > F.lit(start).cast("date"))
    if end is not None:
        df = df.where(d <= F.lit(end).cast("date") if closed in ("both", "right") else d < F.lit(end).cast("date"))
    return df


def in_locations(names: str | list[str], exclude: bool = False) -> Column:
    """Location holds any of the names (``exclude``: none). A text ``A,B`` is a list, ``~A,B`` an excluded one."""
    if isinstance(names, str):
        exclude, names = exclude or names.startswith("~"), names.removeprefix("~").split(",")
    hit = F.lit(False)
    for n in names:
        hit = hit | F.col("location").contains(n.strip())
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if exclude else hit


def usable(df: DataFrame, reconstructed: str | None = None) -> DataFrame:
    """Rows without a stop mutation and, if that column is named, with a reconstructed sequence."""
    df = df.where(~F.col("m").contains("stop"))
    return df.where(F.col(reconstructed)) if reconstructed else df


def has_extra_indel(parent: str, child: str) -> Column:
    """The child has an insertion or deletion that the parent's text lacks."""
    return F.exists(F.split(child, ","), lambda t: (t.endswith("del") | t.startswith("ins")) & ~F.contains(F.col(parent), t))


def same_length(parent: str, child: str) -> Column:
    return F.length(parent) == F.length(child)


def distinct_variants(df: DataFrame, start: str, end: str, shards: int = 1, seed: int = 0) -> DataFrame:
    """(m, shard): distinct variants of a range of dates without stop, dealt to shards."""
    return usable(date_window(df, start, end)).select("m").distinct().withColumn("shard", F.pmod(rand_key(seed, "m"), F.lit(shards)))


def with_week(df: DataFrame, period: int = 7, min_date: Column | None = None) -> DataFrame:
    """``df`` with the week since the first date of all rows."""
    if min_date is not None:
        return df.withColumn("w", week_index(F.col("d"), min_date, period))
    first = df.agg(F.min("d").alias("_first"))  # one row
    return df.join(F.broadcast(first)).withColumn("w", week_index("d", "_first", period)).drop("_first")


def first_seen(df: DataFrame, key: str = "m") -> DataFrame:
    """The earliest row per key (ties: smallest accession), as (key, d, acc, lineage, location, ...)."""
    rest = [c for c in df.columns if c not in (key, "d", "acc")]
    row = F.min_by(F.struct("d", "acc", *rest), F.struct("d", "acc"))
    return df.groupBy(key).agg(row.alias("_r")).select(key, "_r.*")


def weekly_counts(df: DataFrame) -> DataFrame:
    """(m, w, n)."""
    return df.groupBy("m", "w").agg(F.count("*").alias("n"))


def variant_series(df: DataFrame, last_week: int | Column, discovery: str | date | None = None) -> DataFrame:
    """(m, week, total, counts): counts is the running total of every week from 0 to last_week.

    ``df`` has weeks. Variants that were not seen by ``discovery`` are left out; counts run on.
    """
    seen = F.lit(True) if discovery is None else F.col("d") <= F.lit(discovery).cast("date")
    last = F.lit(last_week) if isinstance(last_week, int) else last_week
    inside = F.col("w").between(F.lit(0), last)
    weekly = df.groupBy("m", "w").agg(F.sum(F.when(inside, 1.0).otherwise(0.0)).alias("n"), F.min(F.when(seen, F.col("w"))).alias("seen"))
    # Running totals in long form; a total stands for the weeks up to the next one with sightings.
    along = Window.partitionBy("m").orderBy("w")
    runs = weekly.select("m", "seen", "w", inside.alias("inside"), F.sum("n").over(along).alias("c"), F.least(F.lead("w", 1).over(along), last + 1).alias("to"))
    entry = F.struct("w", "c", F.coalesce(F.col("to"), last + 1).alias("to"))
    grouped = runs.groupBy("m").agg(F.min("seen").alias("week"), F.array_sort(F.collect_list(F.when(F.col("inside"), entry))).alias("_r")).where("week is not null")
    lead = F.array_repeat(F.lit(0.0), F.coalesce(F.get("_r", F.lit(0))["w"], last + 1))
    counts = F.concat(lead, F.flatten(F.transform("_r", lambda r: F.array_repeat(r["c"], r["to"] - r["w"]))))
    out = grouped.select("m", "week", counts.alias("counts")).withColumn("total", F.element_at("counts", -1))
    return out.select("m", "week", "total", "counts")


def count_at(counts: str, week: str | Column, period: str | Column) -> Column:
    """Running total ``period`` weeks from the first week on."""
    w, p = (F.col(x) if isinstance(x, str) else x for x in (week, period))
    return F.element_at(counts, (w + p).cast("int"))


def variant_counts(df: DataFrame, key: str = "m") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def prevalence(df: DataFrame, key: str = "m") -> DataFrame:
    """(key, n, share): the share of all rows."""
    counts = variant_counts(df, key)
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def frequent_and_rare(df: DataFrame, trailing: int, min_count: int, max_total: int) -> DataFrame:
    """(m, n, kind): frequent from min_count on; rare up to max_total and not seen in the last ``trailing`` weeks."""
    counts = df.groupBy("m").agg(F.count("*").alias("n"), F.max("w").alias("_last"))
    last = df.agg(F.max("w").alias("_end"))
    kind = F.when(F.col("n") >= min_count, "frequent").when((F.col("n") <= max_total) & (F.col("_last") <= F.col("_end") - trailing), "rare")
    return counts.join(F.broadcast(last)).withColumn("kind", kind).where("kind is not null").select("m", "n", "kind")


def validation_targets(df: DataFrame, end: str, lead: int, reference: str | None = None) -> DataFrame:
    """(m, w, n[, seq]): variants first seen in week max - lead + 2 of the rows up to ``end``, with their totals."""
    rows = with_week(date_window(df, end=end))
    last = rows.agg(F.max("w").alias("_end"))
    first = rows.groupBy("m").agg(F.min("w").alias("w"), F.count("*").alias("n"))
    out = first.join(F.broadcast(last)).where(F.col("w") == F.col("_end") - lead + 2).drop("_end")
    return out if reference is None else apply_mutations(out, reference)


def sequences_in_timeframe(df: DataFrame, start: str, end: str) -> DataFrame:
    """(m, d, counts): variants first seen in the range, with counts of every week from their first to the last."""
    # A row a week and variant is all that is shuffled and sorted: dates and counts are plain sums of it.
    weekly = with_week(df).where("m is not null and w is not null").groupBy("m", "w").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    weekly = weekly.groupBy("m").agg(F.min("d").alias("d"), F.min("w").alias("_from"), F.max("w").alias("_to"), F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("_n"))
    weekly = date_window(weekly, start, end)
    dense = F.transform(F.sequence("_from", "_to"), lambda w: F.coalesce(F.try_element_at("_n", w), F.lit(0)))
    return weekly.select("m", "d", dense.alias("counts"))
