"""Substring dedup: paragraphs by MinHash banding, and passages inside paragraphs by winnowed word windows.

Paragraphs are lines of at least ``MIN_WORDS`` words (a parameter; down to a shingle's five). Equal ones fall together first; BANDS bands of ROWS
MinHashes over five-word shingles find similarity 0.8 with probability 1 - (1 - 0.8**3)**10 > 0.999. In a
bucket every class is verified against the bucket's leader by exact Jaccard; then those of a bucket that are
still in different components are verified against each other, block by block: that loses no component, and
only links leave a task. A passage that stands inside other paragraphs is found by its windows of WINDOW
words: of any GUARANTEE words running the window with the smallest hash is kept, so a repeated passage of
WINDOW + SPREAD - 1 = 50 words or more shares one at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.llm.common import connected_components, join_counted, row_key, small, stored

MIN_WORDS = 50
WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 10, 3
WINDOW, SPREAD = 32, 19
#: Buckets of up to SMALL classes are compared by a join, larger ones in blocks.
SMALL, BLOCK = 16, 128
BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
UNITS = "doc_id long, _k long, start int, n_words int, digest long, bands array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits (the finaliser of MurmurHash3)."""
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


class Words:
    """Word hashes of a text and rolling hashes of any run of them."""

    def __init__(self, text: str | None):
        lines = [line.split() for line in (text or "").encode().lower().split(b"\n")]
        self.counts = np.array([len(x) for x in lines])
        self.begins = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(w) for x in lines for w in x], np.uint64)
        self.n = n = len(hashes)
        if len(_powers[0]) <= n:
            for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                _powers[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, base, np.uint64))])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers[0][:n])])

    def runs(self, width: int) -> np.ndarray:
        """Hashes of all runs of ``width`` words."""
        n = self.n - width + 1
        return _mix((self.sums[width:] - self.sums[:n]) * _powers[1][:n]) if n > 0 else np.zeros(0, np.uint64)

    def digests(self, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _mix((self.sums[begins + counts] - self.sums[begins]) * _powers[1][begins] + counts.astype(np.uint64))


def winnow(hashes: np.ndarray, spread: int) -> np.ndarray:
    """Places that hold the last smallest hash of some ``spread`` neighbours in a row."""
    if len(hashes) <= spread:
        return np.array([len(hashes) - 1 - hashes[::-1].argmin()] if len(hashes) else [], np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, spread)
    picks = [at + np.arange(len(v)) + spread - 1 - v[:, ::-1].argmin(axis=1) for at in range(0, len(view), 1 << 14) for v in [view[at : at + (1 << 14)]]]
    return np.unique(np.concatenate(picks))


def minhash_bands(shingles: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys; paragraph i has shingles begins[i] to ends[i] (exclusive)."""
    cuts = np.stack([begins, ends], axis=1).ravel()
    padded = np.append(shingles, np.uint64(0))
    mins = np.stack([np.minimum.reduceat(padded * m + a, cuts)[::2] for m, a in zip(MULTIPLY, ADD)], axis=1)
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(begins), axis=0)
    for r in range(ROWS):
        keys = _mix(keys ^ mins[:, r::ROWS])
    return keys


def _units(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = ["doc_id", "_k", "start", "n_words", "digest", "bands"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for doc, k, text in zip(batch.column("doc_id").to_pylist(), batch.column("_k").to_pylist(), batch.column("text")):
            w = Words(text.as_py())
            long = np.nonzero(w.counts >= min_words)[0]
            if len(long):
                b, c = w.begins[long], w.counts[long]
                keys = minhash_bands(w.runs(WIDTH), b, b + c - WIDTH + 1)
                for x, y in zip(cols, ([doc] * len(b), [k] * len(b), b.tolist(), c.tolist(), w.digests(b, c).view(np.int64).tolist(), keys.view(np.int64).tolist())):
                    x += y
            hashes = w.runs(WINDOW)
            places = winnow(hashes, SPREAD)
            for x, y in zip(cols, ([doc] * len(places), [k] * len(places), places.tolist(), [WINDOW] * len(places), hashes[places].view(np.int64).tolist(), [None] * len(places))):
                x += y
            if len(cols[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names)
                cols = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names)


def _paragraph_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests, sets = [], []
        for text, starts, ids in zip(batch["text"], batch["starts"], batch["ids"]):
            w = Words(text)
            shingles = w.runs(WIDTH)
            by_start = {b: c for b, c in zip(w.begins.tolist(), w.counts.tolist()) if c >= WIDTH}
            for start, digest in zip(starts, ids):
                digests.append(digest)
                sets.append(np.unique(shingles[start : start + by_start[start] - WIDTH + 1]).view(np.int64))
        yield pd.DataFrame({"digest": pd.Series(digests, dtype="int64"), "s": sets})


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose shingle sets have that Jaccard similarity."""
    a, b = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    sized = pairs.join(a, "a").join(b, "b").where(F.least(F.size("sa"), F.size("sb")) >= similarity * F.greatest(F.size("sa"), F.size("sb")))
    return sized.where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def paragraph_components(docs: DataFrame, paragraphs: DataFrame, similarity: float = SIMILARITY, shingler=_paragraph_shingles) -> DataFrame:
    """(digest, component) of every class of paragraphs that a similar other class exists for.

    ``shingler`` makes (digest, s) of batches of text, starts and ids, the places and digests of its paragraphs.
    """
    rep = F.min(F.struct("doc_id", "_k", "start")).alias("rep")
    classes = stored(paragraphs.groupBy("digest").agg(F.count("*").alias("n"), rep, F.first("bands").alias("bands")), "classes")
    keyed = classes.select("digest", "n", F.explode("bands").alias("key"))
    several = stored(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "several")
    keyed = stored(join_counted(keyed, several, ["key"], "c"), "buckets")
    # The leader is the class that meets most others: of near copies, the one they were made from.
    met = keyed.groupBy("digest").agg(F.sum("c").alias("met"))
    leaders = keyed.join(met, "digest").groupBy("key").agg(F.max(F.struct("met", "n", "digest")).alias("l"), F.max("c").alias("c"))
    leaders = stored(leaders.select("key", F.col("l.digest").alias("leader"), "c"), "leaders")
    members = stored(join_counted(keyed.select("key", "digest"), leaders, ["key"], "c").select("key", "digest", "leader", "c"), "members")

    wanted = classes.join(members.select("digest").distinct(), "digest", "left_semi").select("digest", "rep.*")
    wanted = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("_k").alias("_key")).agg(F.collect_list("start").alias("starts"), F.collect_list("digest").alias("ids"))  # of one text
    texts = docs.select("doc_id", "text").join(small(wanted), (row_key() == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = texts.dropDuplicates(["doc_id", "_key"]).select("text", "starts", "ids").mapInPandas(shingler, "digest long, s array<long>")
    sets = stored(sets, "shingles")

    stars = stored(_verified(members.where("digest <> leader").select(F.col("digest").alias("a"), F.col("leader").alias("b")).distinct(), sets, similarity), "stars")
    labels = connected_components(stars)
    placed = stored(members.join(labels.withColumnRenamed("v", "digest"), "digest", "left").select("key", "digest", F.coalesce("component", "digest").alias("component")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("c")).where("x <> y").select("key", "c")
    apart = join_counted(placed, stored(mixed, "mixed"), ["key"], "c").select("key", "digest", "c", "component")
    return connected_components(stars.union(_across(apart, sets, similarity))).withColumnRenamed("v", "digest")


def _across(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components of a bucket: enough of them to join all that are linked.

    The pairs of a small bucket are no more than SMALL / 2 times its members. A large one's members are dealt
    to blocks of about BLOCK, and each two blocks are compared in one task, by matrix products of what their
    sets share; only links leave it.
    """
    placed = stored(placed, "placed")
    few = placed.where(F.col("c") <= SMALL)
    left, right = few.select("key", F.col("digest").alias("a"), F.col("component").alias("ca")), few.select("key", F.col("digest").alias("b"), F.col("component").alias("cb"))
    pairs = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    rows = placed.where(F.col("c") > SMALL).join(sets, "digest").withColumn("block", F.pmod(F.xxhash64("digest"), blocks).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_o"))
    rows = rows.select("key", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), "block", "digest", "component", "s")

    def links(part: pd.DataFrame) -> pd.DataFrame:
        found = []
        if part["component"].nunique() > 1:
            low, high = part["low"].iloc[0], part["high"].iloc[0]
            first, second = (part[part["block"] == b] for b in (low, high))
            sizes = [np.array([len(x) for x in t["s"]]) for t in (first, second)]
            shared = common_counts(list(first["s"]), list(second["s"]))
            close = shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared)
            close &= first["component"].to_numpy()[:, None] != second["component"].to_numpy()[None, :]
            one_each = {}
            for i, j in zip(*np.nonzero(close)):
                one_each[first["component"].iat[i], second["component"].iat[j]] = first["digest"].iat[i], second["digest"].iat[j]
            found = list(one_each.values())
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return _verified(pairs, sets, similarity).union(rows.groupBy("key", "low", "high").applyInPandas(links, "a long, b long"))


def common_counts(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share; in slices of elements, so memory is bounded by the blocks."""
    owners = [np.repeat(np.arange(len(t)), [len(x) for x in t]) for t in (first, second)]
    values = [np.concatenate(t) if t else np.zeros(0, np.int64) for t in (first, second)]
    both = np.intersect1d(*values)
    counts = np.zeros((len(first), len(second)), np.float32)
    places = [np.searchsorted(both, v) for v in values]
    for at in range(0, len(both), 1 << 14):
        sides = []
        for n, (v, p, o) in enumerate(zip(values, places, owners)):
            inside = (p >= at) & (p < min(at + (1 << 14), len(both)))
            inside[inside] = both[p[inside]] == v[inside]
            side = np.zeros(((len(first), len(second))[n], 1 << 14), np.float32)
            side[o[inside], p[inside] - at] = 1
            sides.append(side)
        counts += sides[0] @ sides[1].T
    return counts


def repeats(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, _k, kind, start_word, n_words, component_id, kept): what repeats in other documents, and where.

    One row per paragraph (kind 'paragraph') or window ('passage') that another document has too; kept is
    true for the first of its component by doc_id and place. A paragraph has ``min_words`` words at least, and
    WIDTH of them, for it needs a shingle: WIDTH compares all lines that have one. Rows of one doc_id and text are one document,
    also where the id is null; of repeated rows each gives its rows, and ties of the first are all kept. Very long
    texts are read whole. Null and empty texts, short ones and empty tables give no rows. Other columns, whatever
    their names, are left out.
    """
    least = max(min_words, WIDTH)
    units = stored(docs.select("doc_id", row_key().alias("_k"), "text").mapInArrow(lambda batches: _units(batches, least), UNITS), "units")
    paragraphs, windows = units.where("bands is not null"), units.where("bands is null")

    often = windows.groupBy("digest").agg(F.min("_k").alias("x"), F.max("_k").alias("y"), F.count("*").alias("n")).where("x <> y").select("digest", "n")
    passages = join_counted(windows, stored(often, "often"), ["digest"]).select("doc_id", "_k", F.lit("passage").alias("kind"), "start", "n_words", F.col("digest").alias("component_id"))

    labels = paragraph_components(docs, paragraphs, similarity)
    classes = paragraphs.groupBy("digest").agg(F.count("*").alias("n"), F.min("_k").alias("x"), F.max("_k").alias("y")).join(labels, "digest", "left")
    classes = stored(classes.select("digest", "n", "x", "y", F.coalesce("component", "digest").alias("component_id")), "classes")
    spread = classes.groupBy("component_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("component_id")
    lines = join_counted(paragraphs, stored(classes.join(spread, "component_id", "left_semi").select("digest", "component_id", "n"), "repeated"), ["digest"])
    found = stored(passages.unionByName(lines.withColumn("kind", F.lit("paragraph")).select(*passages.columns)), "repeats")
    first = stored(found.groupBy("kind", "component_id").agg(F.min(F.struct("doc_id", "_k", "start")).alias("f"), F.count("*").alias("n")), "first")
    kept = F.col("f.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("f._k") == F.col("_k")) & (F.col("f.start") == F.col("start"))
    return join_counted(found, first, ["kind", "component_id"]).select("doc_id", "_k", "kind", F.col("start").alias("start_word"), "n_words", "component_id", kept.alias("kept"))


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with all but the kept paragraphs and windows cut from the texts."""
    cuts = repeats(docs, similarity, min_words).where("not kept").groupBy(F.col("doc_id").alias("_llm_id"), F.col("_k").alias("_llm_k"))
    cuts = small(cuts.agg(F.collect_list(F.struct("start_word", "n_words")).alias("_llm_cuts")))  # places in one text

    @F.pandas_udf("string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.Series:
        def one(text, spans):
            if text is None or spans is None or not len(spans):
                return text
            gone = np.zeros(len(text.encode().split()), bool)
            for s in spans:
                gone[s["start_word"] : s["start_word"] + s["n_words"]] = True
            at, out = 0, []
            for line in text.encode().split(b"\n"):
                words = line.split()
                flags = gone[at : at + len(words)]
                at += len(words)
                if not flags.any():
                    out.append(line)
                elif not flags.all():
                    out.append(b" ".join(w for w, g in zip(words, flags) if not g))
            return b"\n".join(out).decode()

        return pd.Series([one(t, p) for t, p in zip(texts, places)], dtype=object)

    same = (row_key() == F.col("_llm_k")) & docs["doc_id"].eqNullSafe(F.col("_llm_id"))
    return docs.join(cuts, same, "left").withColumn("text", cut("text", "_llm_cuts")).select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_k")
