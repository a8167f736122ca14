"""Weekly counts kept up to date from a stream of normalised observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_period_counts(obs: DataFrame, period: str = "7 days", delay: str = "14 days") -> DataFrame:
    """(start, m, n) of a streaming or static table (d, m), for rows at most ``delay`` late.

    The same counts as weekly_counts, by the period's first day; closed periods are final.
    """
    rows = obs.withColumn("ts", F.col("d").cast("timestamp")).withWatermark("ts", delay)
    counts = rows.groupBy(F.window("ts", period), "m").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").cast("date").alias("start"), "m", "n")
