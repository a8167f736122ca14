"""Near-duplicate documents of the pipeline: five-word shingles at Jaccard similarity 0.8.

Candidates are classes of equal texts whose SimHash fingerprints are linked at 2 bits, met at their anchors as in
``op8``, and those that share one of the MinHash bands of ``substring_dedup``: at similarity 0.8 a pair is met with
probability 1 - (1 - 0.8**3)**10 > 0.999 by the bands, above it more often. Every link is verified by exact Jaccard.
Fingerprints alone would miss most: texts at 0.8 differ in 9.7 of 64 bits on average, and a radius that covers them
would place each fingerprint at most of the anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqtrend.llm.common import connected_components, join_counted, row_key, stored
from seqtrend.llm.simhash_dedup import fingerprint, grouped, keep_first, linked_prints
from seqtrend.llm.substring_dedup import SIMILARITY, UNITS, WIDTH, Words, minhash_bands, paragraph_components


def _shingles(w: Words) -> np.ndarray:
    """Hashes of the runs of WIDTH words; of all words where there are fewer, of none without words."""
    return w.runs(min(WIDTH, w.n)) if w.n else np.zeros(0, np.uint64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, bands, prints = [], [], [], []
        for text in batch.column("text"):
            w = Words(text.as_py())
            shingles = _shingles(w)
            prints.append(fingerprint(text.as_py()))
            sizes.append(w.n)
            digests.append(int(w.digests(np.zeros(1, np.int64), np.array([w.n])).view(np.int64)[0]))
            bands.append(minhash_bands(shingles, np.array([0]), np.array([len(shingles)]))[0].view(np.int64).tolist() if w.n else None)
        cols = [batch.column("doc_id"), batch.column("_k"), pa.array([0] * len(sizes), pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_k", "start", "n_words", "digest", "bands", "print"])


def _document_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [np.unique(_shingles(Words(t))).view(np.int64) for t in batch["text"]]
        yield pd.DataFrame({"digest": pd.Series([i[0] for i in batch["ids"]], dtype="int64"), "s": sets})


def candidates(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """(doc_id, _k, start, n_words, digest, bands) of every row; the last of the bands is that of the fingerprint's component.

    Fingerprints at ``max_bits`` bits or fewer are linked. Null and empty texts have no bands.
    """
    rows = stored(docs.select("doc_id", row_key().alias("_k"), "text").mapInArrow(_units, UNITS + ", print long"), "digests")
    prints = stored(rows.groupBy("print").agg(F.count("*").alias("n")), "prints")
    labels = connected_components(linked_prints(prints.select(F.col("print").alias("fp")), max_bits)).withColumnRenamed("v", "print")
    linked = stored(prints.join(labels, "print", "left").select("print", "n", F.coalesce("component", "print").alias("component")), "linked")
    band = F.xxhash64(F.lit("simhash"), "component")
    named = join_counted(rows, linked, ["print"]).withColumn("bands", F.concat("bands", F.array(band)))
    return stored(named.select("doc_id", "_k", "start", "n_words", "digest", "bands"), "candidates")


def jaccard_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, _k, fp, component_id): the smallest doc_id reachable over links of that similarity; fp is the digest of the words.

    Texts of equal words are copies, among them all without words. Rows with a null doc_id take part; a group
    of only such rows has a null component_id. Very long texts are compared whole; other columns of any name are
    left out. An empty table gives an empty result.
    """
    rows = candidates(docs)
    labels = paragraph_components(docs, rows, similarity, _document_shingles)
    return grouped(rows.select("doc_id", "_k", rows["digest"].alias("fp")), labels.withColumnRenamed("digest", "fp"))


def keep_one_per_group(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, of which repeats go too."""
    return keep_first(docs, jaccard_groups(docs, similarity))
