"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Only DataFrame functions run. Windows have as many words as a benchmark item and are aligned on a word
shingle that the item has too; a window without one has similarity 0. Windows and items whose fingerprints
differ in at most ``RADIUS`` bits agree in one of ``RADIUS`` + 1 blocks of bits (pigeonhole), so joining on
the item and the blocks finds all of them. At similarity 0.8 about 1 window of 1,000 is beyond the radius, at
0.9 fewer: that is the recall. What is left is verified by exact weighted-shingle similarity: the sum of the
smaller over the sum of the larger weights, a shingle's weight being how often it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.llm.common import keyed_anti, let, row_key, small, stored

WIDTH = 5
SIMILARITY = 0.8
#: At similarity 0.8 two fingerprints differ in 9.7 of 64 bits on average, standard deviation 2.9.
RADIUS = 19
LANES = 0x0000000100000001
KEY = ["doc_id", "_k"]


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words (runs of letters and digits) of a text, in order."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words; empty if there are fewer words."""
    one = lambda h: lambda i: F.xxhash64(*[h[i + j] for j in range(width)])
    runs = lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(0), F.size(h) - width), one(h)))
    return F.coalesce(let(hashes, runs), F.array().cast("array<bigint>"))


def simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp): 64-bit SimHash of the shingles (column s, repeats included) of each key.

    A sum holds the counts of two bits, 32 bits apart, so 32 sums make the 64 counts.
    """
    sums = [F.sum(F.shiftrightunsigned("s", b).bitwiseAND(F.lit(LANES))).alias(f"_l{b}") for b in range(32)]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *sums)
    fp = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"_l{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_l{b}", 32)
        fp = fp.bitwiseOR(F.when(low * 2 > F.col("_n"), F.lit(1 << b).cast("long")).otherwise(0))
        fp = fp.bitwiseOR(F.when(high * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), b + 32)).otherwise(0))
    return counted.select(*keys, fp.alias("fp"))


def blocks(fp: Column, radius: int) -> Column:
    """array<struct<block,bits>>: the fingerprint cut into ``radius`` + 1 blocks."""
    cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    cut = lambda i: F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << cuts[i + 1] - cuts[i]) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), cut(i).alias("bits")) for i in range(radius + 1)])


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, width, sh): items with a word; the width is WIDTH, or all words of a shorter item."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    width = F.least(F.size("h"), F.lit(WIDTH))
    cases = F.coalesce(*[F.when(width == k, shingles(F.col("h"), k)) for k in range(1, WIDTH + 1)])
    return items.select("item_id", F.size("h").alias("words"), width.alias("width"), cases.alias("sh"))


def _doc_shingles(docs: DataFrame, width: int) -> DataFrame:
    return docs.select("doc_id", row_key().alias("_k"), shingles(word_hashes(F.col("text")), width).alias("sh"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, _k, item_id, similarity, start_word, n_words): the best window of each document for each item.

    Null and empty texts, and items without words, match nothing. Repeated items each match. Rows of one
    doc_id and text give one result; rows with a null doc_id take part. Very long texts are searched whole; of
    equally similar windows the first counts; other columns of any name are left out. Empty tables give an empty
    result.
    """
    items = stored(item_table(benchmark), "items")
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()]  # at most WIDTH values
    found = [_at_width(docs, items.where(F.col("width") == w), w, similarity, radius) for w in widths]
    if not found:
        return docs.limit(0).select("doc_id", row_key().alias("_k"), F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _at_width(docs: DataFrame, items: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    item_rows = items.select("item_id", "words", F.posexplode("sh").alias("q", "s"))
    # Every place of a shingle in an item, so that every window is aligned that shares one in its place.
    anchors = small(item_rows.select("item_id", "words", "s", "q"))
    probes = _doc_shingles(docs, width).select(*KEY, F.size("sh").alias("n"), F.posexplode("sh").alias("p", "s"))
    span = F.col("words") - (width - 1)
    start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - span))
    hits = stored(probes.join(anchors, "s").select(*KEY, "words", start.alias("start"), "item_id").distinct(), "windows")
    at = [*KEY, "words", "start"]

    touched = small(hits.select(F.col("doc_id").alias("_id"), F.col("_k").alias("_key")).distinct())
    texts = docs.select("doc_id", "text").join(touched, (row_key() == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sources = _doc_shingles(texts.dropDuplicates(["doc_id", "text"]), width).toDF("_id", "_key", "sh")
    windows = hits.select(*at).distinct().join(sources, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    windows = windows.select(*at, F.slice("sh", F.col("start") + 1, span).alias("ws"))
    window_rows = stored(windows.select(*at, F.explode("ws").alias("s")).groupBy(*at, "s").agg(F.count("*").alias("w")), "window_shingles")
    each = lambda rows: rows.select("*", F.explode(F.array_repeat(F.lit(0), F.col("w").cast("int")))).drop("col")

    window_prints = simhash(each(window_rows), at)
    item_weights = item_rows.groupBy("item_id", "words", "s").agg(F.count("*").alias("v"))
    item_prints = simhash(item_rows, ["item_id", "words"])
    cut = lambda prints, name: prints.select("*", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("*", "b.*").drop("b").withColumnRenamed("fp", name)
    # A window goes with the items it shares a shingle with, so a block of few bits meets few of the items.
    same_at = (F.col("_k") == F.col("_hk")) & F.col("doc_id").eqNullSafe(F.col("_hid")) & (F.col("words") == F.col("_hwords")) & (F.col("start") == F.col("_hstart"))
    anchored = window_prints.join(hits.toDF("_hid", "_hk", "_hwords", "_hstart", "item_id"), same_at).select(*at, "fp", "item_id")
    pairs = cut(anchored, "fp").join(small(cut(item_prints, "item_fp")), ["item_id", "words", "block", "bits"])
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*at, "item_id").distinct()

    shared = pairs.join(small(item_weights.drop("words")), "item_id")
    w = window_rows.toDF("_id", "_key", "_words", "_start", "_s", "w")
    same = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_words") == F.col("words")) & (F.col("_start") == F.col("start"))
    totals = window_rows.groupBy(*at).agg(F.sum("w").alias("_n")).toDF("_id", "_key", "_words", "_start", "window_n")
    overlap = shared.join(w, same & (F.col("_s") == F.col("s"))).groupBy(*at, "item_id").agg(F.sum(F.least("w", "v")).alias("both"))
    scored = overlap.join(totals, same).select(*at, "item_id", (F.col("both") / (F.col("window_n") + span - F.col("both"))).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "words")).alias("b")
    scored = scored.where(F.col("similarity") >= similarity).groupBy(*KEY, "item_id").agg(best)
    return scored.select(*KEY, "item_id", "b.similarity", (-F.col("b.start")).alias("start_word"), F.col("b.words").alias("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    return keyed_anti(docs, contaminated(docs, benchmark).select(*KEY))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).drop("_k")
