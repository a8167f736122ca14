"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code: two perfect binary Golay codes (23 bits, covering radius 3) side
by side over 46 of the 64 fingerprint bits. A fingerprint's home is its nearest anchor. Fingerprints that
differ in at most ``max_bits`` bits (e1 and e2 of them in the two halves) meet at the home of either: the
other one lies within covering radius + e of that anchor in each half. So every fingerprint goes once to its
home and once to every anchor within covering radius plus threshold, and pairs are compared per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.llm.common import connected_components, join_counted, keyed_anti, row_key, stored

SEED = 42
HALF, RADIUS = 23, 3  # of the binary Golay code


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    width = min(width, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_k"), pa.array(prints.view(np.int64))], ["doc_id", "_k", "fp"])


@lru_cache(maxsize=1)
def golay_words() -> np.ndarray:
    """The 4,096 words of the cyclic [23, 12] code generated by x^11+x^9+x^7+x^6+x^5+x+1."""
    words = np.zeros(1, dtype=np.uint32)
    for shift in range(12):
        words = np.concatenate([words, words ^ np.uint32(0b101011100011 << shift)])
    return words


def anchors(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchor of each fingerprint, then (row, anchor) of all within covering radius plus threshold."""
    code, mask = golay_words(), np.uint64((1 << HALF) - 1)
    halves = [((prints >> np.uint64(s)) & mask).astype(np.uint32) for s in (0, HALF)]
    far = [np.bitwise_count(code[None, :] ^ h[:, None]) for h in halves]
    near = [d.argmin(axis=1) for d in far]
    home = near[0].astype(np.int64) << 12 | near[1]
    rows, keys = [], []
    # A pair's first half differs in e bits at most, the second in the rest: shells of the first, balls of the second.
    ball = [[np.nonzero(d <= RADIUS + e) for e in range(max_bits + 1)] for d in far]
    for e in range(max_bits + 1):
        r1, c1 = ball[0][e]
        if e:
            new = far[0][r1, c1] > RADIUS + e - 1
            r1, c1 = r1[new], c1[new]
        r2, c2 = ball[1][max_bits - e]
        begin, count = np.searchsorted(r2, r1, "left"), np.searchsorted(r2, r1, "right") - np.searchsorted(r2, r1, "left")
        pick = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        rows.append(np.repeat(r1, count))
        keys.append(np.repeat(c1.astype(np.int64), count) << 12 | c2[pick])
    return home, np.concatenate(rows), np.concatenate(keys)


def _anchored(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 512):
                prints = every[at : at + 512]
                home, rows, keys = anchors(prints.view(np.uint64), max_bits)
                fp, key = np.concatenate([prints, prints[rows]]), np.concatenate([home, keys])
                is_home = np.arange(len(fp)) < len(prints)
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(key), pa.array(is_home)], ["fp", "anchor", "home"])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, _k, fp) of every row; null and empty texts have fingerprint 0."""
    return docs.select("doc_id", row_key().alias("_k"), "text").mapInArrow(_fingerprints, "doc_id long, _k long, fp long")


def linked_prints(prints: DataFrame, max_bits: int) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints (column fp) at ``max_bits`` bits or fewer, once each."""
    # A few bytes a row make many copies: they are made in as many tasks as a shuffle has, not one per file split.
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    placed = stored(prints.mapInArrow(_anchored(max_bits), "fp long, anchor long, home boolean"), "anchors")
    homes = placed.where("home").select("anchor", F.col("fp").alias("b")).hint("shuffle_hash")
    copies = placed.where("not home").select("anchor", F.col("fp").alias("a"))
    return copies.join(homes, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def simhash_groups(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """(doc_id, _k, fp, component_id): the smallest doc_id reachable over links of ``max_bits`` bits or fewer.

    Null and empty texts have fingerprint 0, which is linked like any other. Copies fall together by
    fingerprint before any comparison. Rows with a null doc_id take part; a group of only such rows has a
    null component_id. Very long texts are fingerprinted whole; other columns of any name are left out. An
    empty table gives an empty result.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    prints = _classes(rows)
    return grouped(rows, connected_components(linked_prints(prints.select("fp"), max_bits)).withColumnRenamed("v", "fp"), prints)


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, first, n): the smallest doc_id and the number of rows of each fp."""
    return stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "prints")


def grouped(rows: DataFrame, labels: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """``rows`` (doc_id, _k, fp) with the smallest doc_id of the component of their fp; ``labels``: (fp, component)."""
    prints = _classes(rows) if prints is None else prints
    linked = prints.join(labels, "fp")
    lowest = linked.groupBy("component").agg(F.min("first").alias("lowest"))
    linked = linked.join(lowest, "component").select("fp", "lowest")
    groups = prints.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"), "n")
    return join_counted(rows, stored(groups, "groups"), ["fp"]).select("doc_id", "_k", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id, of which repeats go too.

    In a group of only null ids the row of the smallest key stays.
    """
    return keep_first(docs, simhash_groups(docs, max_bits))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each of the ``groups`` (doc_id, _k, fp, component_id)."""
    groups = stored(groups, "groups")
    nameless = groups.where("component_id is null").groupBy("fp").agg(F.min("_k").alias("_k"))
    stays = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.min("_k").alias("_k"), F.count("*").alias("n"))
    keys = stays.select("doc_id", "_k").union(nameless.select(F.lit(None).cast("long"), "_k"))
    drops = groups.join(keys, (groups["_k"] == keys["_k"]) & groups["doc_id"].eqNullSafe(keys["doc_id"]), "left_anti")
    kept = keyed_anti(docs, drops.select("doc_id", "_k"))
    repeated = stays.where("n > 1").select("doc_id").union(groups.groupBy("doc_id").count().where("doc_id is null and count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    again = repeated.withColumnRenamed("doc_id", "_llm_id")
    same = kept["doc_id"].eqNullSafe(again["_llm_id"])
    return kept.join(again, same, "left_anti").union(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
