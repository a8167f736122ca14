"""The one contract for randomness: a key that is a pure function of the row, so retries draw the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rand_key(seed: int | str, *cols: Column | str) -> Column:
    """60 random bits from a seed and columns: the first 15 hex digits of a SHA-256."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.left(F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts), 256), F.lit(15)), 16, 10).cast("long")


def rand_share(seed: int | str, *cols: Column | str) -> Column:
    """The key as a number in [0, 1)."""
    return rand_key(seed, *cols).cast("double") / float(1 << 60)
