"""Approximate nearest neighbours: a forest of sorted arrays of long hash strings (LSH forest).

The vectors are dealt to segments of bounded size by a hash, each indexed once, by one task. A segment has, per
tree, the sorted array of its vectors' hash strings of ``BITS`` bits, which are the sides of planes drawn from one
pool. A query descends in every tree to its longest prefix match and then all trees ascend together: what shares
a prefix in some tree is compared exactly. The ascent ends where a vector as near as the k-th found would hardly
(``MISS``) be missed by all trees, so near neighbours need few candidates, and far ones, in random directions,
many. The queries, a stated set, are shuffled to all segments and stream past them after the segment's vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BITS, TREES, PLANES = 24, 256, 512
SEGMENT_ROWS = 16_384
#: Chance that a vector as near as the k-th found shares no prefix with its query in any tree.
MISS = 0.1
#: Queries that descend together.
TOGETHER = 512
SEED = 7


def hash_strings(vectors: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """(trees, n) hash strings as integers: the signs of random projections, highest bit first.

    The planes pass through the origin: directions, then, decide, and exact distances correct for length.
    """
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((vectors.shape[1], PLANES))
    drawn = np.argsort(rng.random((trees, PLANES)), axis=1)[:, :bits]  # each tree's planes
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = (vectors / norms @ planes > 0).T
    out = np.zeros((trees, len(vectors)), np.int64)
    for b in range(bits):
        out = out << 1 | signs[drawn[:, b]]
    return out


class Forest:
    """The sorted hash strings of the distinct vectors of one segment."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.vectors, inverse = np.unique(vectors, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        # Of equal vectors only the smallest ``keep`` ids can be among a query's nearest.
        members = np.argsort(inverse, kind="stable")
        begin = np.searchsorted(inverse[members], np.arange(len(self.vectors)))
        self.members = [ids[members[b : min(e, b + keep)]] for b, e in zip(begin, [*begin[1:], len(ids)])]
        self.trees, self.bits, self.seed = trees, bits, seed
        hashes = hash_strings(self.vectors, trees, bits, seed)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, miss: float = MISS) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query id, ids, distances, vectors compared): the k nearest of each query but itself, nearest first."""
        hashes = hash_strings(queries, self.trees, self.bits, self.seed)
        # Per query: the size at which it is compared again, and the level that its k-th found calls for.
        again, wanted, done = np.full(len(queries), k + 1), np.zeros(len(queries), int), np.zeros(len(queries), bool)
        for level in range(self.bits, -1, -1):  # synchronous ascent
            shift = self.bits - level
            low = np.stack([np.searchsorted(s, (h >> shift) << shift, "left") for s, h in zip(self.sorted, hashes)])
            high = np.stack([np.searchsorted(s, ((h >> shift) + 1) << shift, "left") for s, h in zip(self.sorted, hashes)])
            sizes = (high - low).sum(axis=0)  # a vector counts once a tree
            for q in np.nonzero(~done & ((sizes >= again) | (level <= wanted)))[0]:
                found = self._sharing(low[:, q], high[:, q])
                ids, distance, angle = self._compare(found, query_ids[q], queries[q], k)
                wanted[q] = self.level_for(angle, miss) if len(ids) == k else 0
                if level <= wanted[q]:
                    done[q] = True
                    yield query_ids[q], ids, distance, len(found)
                again[q] = 2 * sizes[q]  # so that all comparisons of a query are at most about twice its last
            if done.all():
                break

    def level_for(self, angle: float, miss: float) -> int:
        """The longest prefix that some tree shares with chance 1 - ``miss``, for a vector at that angle."""
        same = 1 - angle / np.pi  # a plane has both on one side
        need = 1 - miss ** (1 / self.trees)  # chance in one tree
        return self.bits if same >= 1 else int(np.log(need) / np.log(same)) if same > 0 else 0

    def _sharing(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The distinct vectors (indices) in the ranges of all trees."""
        mask = np.zeros(len(self.vectors), bool)
        for t in np.nonzero(high > low)[0]:
            mask[self.order[t, low[t] : high[t]]] = True
        return np.nonzero(mask)[0]

    def _compare(self, found: np.ndarray, qid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(ids, distances, widest angle to the query) of the k nearest of the found vectors but the query."""
        vectors = self.vectors[found]
        distance = np.sqrt(((vectors - q) ** 2).sum(axis=1))
        if len(found) > k + 1:  # ties of the last stay
            near = distance <= np.partition(distance, k)[k]
            found, vectors, distance = found[near], vectors[near], distance[near]
        held = [self.members[v] for v in found]
        ids, which = np.concatenate([np.zeros(0, np.int64), *held]), np.repeat(np.arange(len(held)), [len(m) for m in held])
        other = ids != qid
        ids, which = ids[other], which[other]
        best = np.lexsort((ids, distance[which]))[:k]
        ids, which = ids[best], which[best]
        if not len(ids):
            return ids, distance[which], np.pi
        chosen = vectors[which]
        cosine = chosen @ q / (np.linalg.norm(chosen, axis=1) * np.linalg.norm(q))
        return ids, distance[which], float(np.arccos(np.clip(cosine.min(), -1, 1)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles, without the null, empty, zero and non-finite ones and null ids."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    return rows.where(~odd).where(F.exists("v", lambda x: x != 0))


def _search(k: int, miss: float):
    """Rows come by segment, its vectors before the queries: the forest stands when the first query comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, ids, rows, forests = None, [], [], None
        for batch in batches:
            of, asks = batch.column("segment").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            vec_ids = batch.column("vec_id").to_numpy()
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            vectors = np.split(batch.column("v").flatten().to_numpy(), np.cumsum(sizes)[:-1])
            turns = np.nonzero((np.diff(of) != 0) | (np.diff(asks.astype(int)) != 0))[0] + 1
            for begin, end in zip([0, *turns], [*turns, len(of)]):
                if begin == end:
                    continue
                if of[begin] != segment:
                    segment, ids, rows, forests = of[begin], [], [], None
                if not asks[begin]:
                    ids += vec_ids[begin:end].tolist()
                    rows += [np.array(v) for v in vectors[begin:end]]
                    continue
                if forests is None:
                    forests = {}
                    for dim in {len(v) for v in rows}:
                        pick = [i for i, v in enumerate(rows) if len(v) == dim]
                        forests[dim] = Forest(np.array([ids[i] for i in pick], np.int64), np.array([rows[i] for i in pick]), k + 1)
                    ids, rows = [], []
                for at in range(begin, end, TOGETHER):
                    yield from _answers(forests, vec_ids[at : min(at + TOGETHER, end)], vectors[at : min(at + TOGETHER, end)], k, miss)

    return run


def _answers(forests: dict[int, Forest], query_ids: np.ndarray, queries: list, k: int, miss: float) -> Iterator[pa.RecordBatch]:
    for dim in sorted({len(q) for q in queries} & forests.keys()):
        pick = [i for i, q in enumerate(queries) if len(q) == dim]
        for qid, near, far, compared in forests[dim].nearest(query_ids[pick], np.array([queries[i] for i in pick]), k, miss):
            columns = [np.full(len(near), qid), near, far, np.full(len(near), compared)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "compared"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, miss: float = MISS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance.

    Both tables have vec_id and embedding. Vectors that are null, empty or zero, or hold null or non-finite
    parts, take no part; vectors of another length than the query's are no candidates. A query is not its
    own candidate (same vec_id). Ties go to the smaller vec_id. Equal vectors are indexed once a segment.
    Repeated rows (same vec_id and vector) count once in both tables; different vectors of one vec_id are rows
    of their own, and need distinct ids. Other columns of any name are left out.
    """
    found = matches(vectors, queries, k, miss, segment_rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matches(vectors: DataFrame, queries: DataFrame, k: int = 10, miss: float = MISS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(query_id, vec_id, score, compared): the k nearest of every segment, and how many of it were compared."""
    indexed, asked = usable(vectors), usable(queries).distinct()
    segments = max(1, -(-indexed.count() // segment_rows))
    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(segments)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))
    rows = indexed.distinct().select(dealt.alias("segment"), F.lit(False).alias("asks"), "vec_id", "v")
    rows = rows.union(asked.select(everywhere.alias("segment"), F.lit(True).alias("asks"), "vec_id", "v"))
    rows = rows.repartitionById(segments, "segment").sortWithinPartitions("segment", "asks")
    return rows.mapInArrow(_search(k, miss), "query_id long, vec_id long, score double, compared long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
