import hashlib

import numpy as np
import pytest

from seqtrend.llm import clustering as C


def brute(rows, k, rounds):
    """Every vector against every centroid, in Python's integers."""
    rows = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted((r for r in rows if r[0] is not None), key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, v in rows:
            held[near(v)[1]].append(v)
        centroids = [[sum(x) // len(h) for x in zip(*h)] if h else c for h, c in zip(held, centroids)]
    found = [(i, *near(v)) for i, v in rows]
    total = sum(d for _, d, _ in found)
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return [(i, c, d, sum(e for _, e, o in found if o == c), total, digest(centroids[c])) for i, d, c in found]


def shape(rows):
    return sorted(rows, key=str)


def made(n, seed, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.3, 64)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(hot)]


@pytest.mark.parametrize("n, hot, k, pivots", [(300, 0, 12, 48), (200, 100, 12, 4), (90, 0, 40, 1), (7, 0, 12, 48)])
def test_against_brute_force(spark, n, hot, k, pivots):
    rows = made(n, n, hot)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = C.cluster(df, k=k, rounds=3, pivots=pivots).collect()
    assert shape(tuple(r)[:6] for r in got) == shape(brute(rows, k, 3))
    if (n, hot) == (300, 0):
        assert sum(r.compared for r in got) < 300 * 4  # the bounds do the most


def test_bounds_hold():
    rng = np.random.default_rng(1)
    vectors, centroids = rng.integers(-400, 400, (500, 64)), rng.integers(-100, 100, (30, 64))
    square = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    for most in (1, 2, 9, 65):
        simplex = C.Simplex(np.vstack([vectors[:80], vectors[:3]]), most)
        a, c = (simplex.apex(simplex.distances(x.astype(float))) for x in (vectors, centroids))
        flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(axis=2)
        assert (flat + (a[:, None, -1] - c[None, :, -1]) ** 2 <= square * (1 + 1e-9) + 1e-6).all()
        assert (flat + (a[:, None, -1] + c[None, :, -1]) ** 2 >= square * (1 - 1e-9) - 1e-6).all()
        mask = C.candidates(a, c)
        assert mask[np.arange(500), square.argmin(axis=1)].all()
        if most == 65:
            assert mask.sum() < 520


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [float(i % 7) - 3 for i in range(64)]
    rows = [(1, good), (1, good), (1, [-x for x in good]), (None, good), (2, None), (3, []), (4, good[:63]), (5, [*good, 1.0]), (6, [nan] * 64)]
    rows += [(7, [inf] * 64), (8, [*good[:63], None]), (9, [0.0] * 64), (None, None), (10, [1e30] * 64)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, cluster string, compared int")
    got = C.cluster(df).drop("compared").collect()
    kept = [(1, good), (1, good), (1, [-x for x in good]), (None, good), (9, [0.0] * 64)]
    assert shape(tuple(r) for r in got) == shape(brute(kept, 40, 5))
    assert C.cluster(df.limit(0)).collect() == [] and C.cluster(df.where("vec_id is null")).collect() == []


def test_rows_per_task_are_bounded(spark):
    """A cluster that holds everything leaves a task as one row of sums."""
    df = spark.createDataFrame([(i, [0.5] * 64) for i in range(500)], "vec_id long, embedding array<float>").repartition(7)
    got = C.cluster(df).collect()
    assert {(r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in got} == {(0, 0, 0, 0)} and len(got) == 500
