"""Centroid clustering in integers, with centroids filtered by an n-simplex projection.

A few pivots span a simplex. A vector's distances to them, taken once and stored, are turned into the
coordinates of the apex of a simplex over that base: its place in the pivots' flat, and its height above it.
For two apexes the distance with both heights on one side is a lower bound of the distance of the vectors,
that with the heights on opposite sides an upper bound. A centroid whose lower bound is above the smallest
upper bound can't be nearest; only the others are compared, exactly and in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtrend.llm.common import stored

DIM, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
#: At most so many pivots, from the starting centroids and, after the first round, from the first means too.
PIVOTS = 48
#: Components beyond this have squared distances that no long holds.
MOST = 1 << 27
#: A pivot nearer than this share of the first edge to the flat of those before it adds nothing but rounding errors.
FLAT = 1e-3
#: What the bounds give way, in parts of the squared lengths that they are made of; doubles err by far less.
SLACK = 1e-9


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): components times ``scale``, rounded down, of vectors with exactly ``dim`` finite components."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * float(scale)) > float(MOST)))
    rows = vectors.select("vec_id", x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dim)).where(~odd)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale)).cast("long")).alias("q"))


def starting_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the k smallest SHA-256 of ``seed:vec_id``, in that order; equal ids in the order of their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").orderBy(key, "q").limit(k).select("q").collect()  # k rows
    return np.array([r.q for r in first], np.int64)


class Simplex:
    """The base simplex of some pivots, lower-triangular: pivot i has i coordinates that are not 0."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        """Pivots one after another: the point furthest from the flat of those before."""
        points = points.astype(float)
        chosen, edges = [0], np.zeros((0, points.shape[1]))
        rest = points - points[0]
        first = 0.0
        while len(chosen) < most:
            height = np.linalg.norm(rest, axis=1)
            far = int(height.argmax())
            first = first or height[far]
            if height[far] == 0 or height[far] < FLAT * first:
                break
            unit = rest[far] / height[far]
            edges = np.vstack([edges, unit])
            rest = rest - np.outer(rest @ unit, unit)
            chosen.append(far)
        self.pivots = points[chosen]
        between = self.pivots - self.pivots[0]
        self.base = np.tril((between @ edges.T)[1:])
        self.square = (between[1:] ** 2).sum(axis=1)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return np.stack([((vectors - p) ** 2).sum(axis=1) for p in self.pivots], axis=1)

    def apex(self, square: np.ndarray) -> np.ndarray:
        """Coordinates in the flat, and the height above it as the last one, from squared distances to the pivots."""
        right = (square[:, :1] - square[:, 1:] + self.square) / 2
        flat = np.zeros_like(right)
        for i in range(len(self.base)):
            flat[:, i] = (right[:, i] - flat[:, :i] @ self.base[i, :i]) / self.base[i, i]
        height = np.sqrt(np.maximum(0.0, square[:, 0] - (flat**2).sum(axis=1)))
        return np.hstack([flat, height[:, None]])


def candidates(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) true where the lower bound of the distance is not above the vector's smallest upper bound."""
    flat = ((apexes[:, None, :-1] - centroids[None, :, :-1]) ** 2).sum(axis=2)
    a, c = apexes[:, None, -1], centroids[None, :, -1]
    slack = SLACK * ((apexes**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1)[None, :]) + 1e-6
    low, high = flat + (a - c) ** 2 - slack, flat + (a + c) ** 2 + slack
    return low <= high.min(axis=1, keepdims=True)


def nearest_exact(vectors: np.ndarray, centroids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid among the candidates; ties to the smaller number."""
    row, number = np.nonzero(mask)
    square = np.concatenate([((vectors[row[at : at + 65536]] - centroids[number[at : at + 65536]]) ** 2).sum(axis=1) for at in range(0, max(1, len(row)), 65536)])
    order = np.lexsort((number, square, row))
    first = order[np.searchsorted(row[order], np.arange(len(vectors)))]
    return number[first].astype(np.int32), square[first]


def _lists(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _assigned(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: np.ndarray, rows: int = 4096):
    apexes = simplex.apex(simplex.distances(centroids.astype(float)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            q, a = _lists(part.column("q"), "i8", centroids.shape[1]), _lists(part.column("apex"), "f8", apexes.shape[1])
            mask = candidates(a, apexes)
            yield part, q, mask, *nearest_exact(q, centroids, mask)


def with_apexes(rows: DataFrame, simplex: Simplex) -> DataFrame:
    """``rows`` with the cached distances to the pivots as ``apex``."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apex = simplex.apex(simplex.distances(_lists(batch.column("q"), "f8", simplex.pivots.shape[1])))
            ends = pa.array(np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), pa.ListArray.from_arrays(ends, pa.array(apex.ravel()))], ["vec_id", "q", "apex"])

    return rows.mapInArrow(project, "vec_id long, q array<long>, apex array<double>")


def assign(rows: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of rows with apexes; ``compared`` says with how many centroids a vector was compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, mask, number, square in _assigned(batches, simplex, centroids):
            arrays = [part.column("vec_id"), pa.array(number), pa.array(square), pa.array(mask.sum(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance", "compared"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, compared int")


def next_centroids(rows: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of every cluster's mean; an empty cluster keeps its centroid.

    Each task adds its vectors up by cluster; its sums, at most one row a cluster, are added exactly.
    """
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q, _, number, _ in _assigned(batches, simplex, centroids):
            there = np.unique(number)
            sums = np.stack([q[number == c].sum(axis=0) for c in there])
            ends = pa.array(np.arange(len(there) + 1, dtype=np.int32) * dim)
            counts = pa.array(np.bincount(number, minlength=k)[there].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(there), counts, pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], ["cluster", "n", "sums"])

    parts = rows.mapInArrow(run, "cluster int, n long, sums array<long>")
    exact = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # k rows
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, pivots: int = PIVOTS, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared) per vector that takes part.

    ``vectors`` has vec_id and embedding; other columns are left out. Vectors that are null, have another number
    of components, or hold null or non-finite ones, take no part; nor do those with a component beyond 524,288
    (2**27 when scaled), whose squared distances no long holds. Repeated rows count each; equal ids with
    different vectors are rows of their own, started from in the order of the vectors; a null id takes part but
    is no starting centroid. Ties go to the smaller number. With fewer than k vectors there are as many
    centroids; an empty table stays empty, and so does one without any id. An inertia that no long holds is null. Only the k centroids and
    their sums pass through the driver.
    """
    rows = quantised(vectors, dim)
    centroids = starting_centroids(rows, k, seed)
    columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], columns)
    simplex = Simplex(centroids, pivots)
    rows = stored(with_apexes(rows, simplex), "apexes")
    for i in range(rounds):
        before, centroids = centroids, next_centroids(rows, simplex, centroids)
        if (before == centroids).all():  # all later rounds give the same
            break
        if i == 0:
            # Means lie far from the flat of the vectors they started from, but later means near that of the first.
            simplex = Simplex(np.vstack([centroids, before]), pivots)
            rows = stored(with_apexes(rows.drop("apex"), simplex), "apexes")
    found = stored(assign(rows, simplex, centroids), "clusters")
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()])
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_s"))
    # One row a cluster, so at most k: one task adds them up, and they are broadcast.
    sums = sums.withColumn("_all", F.sum("_s").over(Window.partitionBy(F.lit(0))))
    out = found.join(F.broadcast(sums), "cluster")
    return out.select("vec_id", "cluster", "distance", F.expr("try_cast(_s as bigint)").alias("cluster_inertia"), F.expr("try_cast(_all as bigint)").alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256"), "compared")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("compared")


def _op11_sql() -> str:
    """The rounds one after another, each vector compared with every centroid."""

    def nearest(name: str, centroids: str) -> str:
        square = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""{name} AS MATERIALIZED (
  SELECT vec_id, q, n[1] AS distance, n[2] AS cluster FROM (
    SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, min([CAST({square} AS BIGINT), c.cluster]) AS n
    FROM v, {centroids} c GROUP BY v.r))"""

    parts = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE}.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS cluster, q FROM v
  WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), q LIMIT {K})"""]  # fmt: skip
    for i in range(ROUNDS):
        parts.append(nearest(f"a{i}", f"c{i}"))
        parts.append(f"""m{i} AS MATERIALIZED (
  SELECT cluster, list(x ORDER BY i) AS q FROM (
    SELECT cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
    FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}) GROUP BY cluster, i) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m{i}.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} USING (cluster))""")
    parts.append(nearest("a", f"c{ROUNDS}"))
    return f"""WITH {",".join(parts)}
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a JOIN c{ROUNDS} c USING (cluster)"""


OP11_SQL = _op11_sql()
