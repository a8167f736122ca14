import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from seqtrend.llm import sharding as S


def brute(rows, limit):
    """Shards by recursive splitting."""
    h = lambda d, t: int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
    out = {}

    def split(items, depth, prefix):
        if sum(b for _, b in items) <= limit or len(items) <= 1 or depth == 60:
            for x, _ in items:
                out[x] = (1 << depth) + prefix
            return
        sides = defaultdict(list)
        for x, b in items:
            sides[x >> (59 - depth)].append((x, b))
        for p, side in sides.items():
            split(side, depth + 1, p)

    split([(h(d, t), len((t or "").encode())) for d, t in rows], 0, 0)
    return [(d, out[h(d, t)]) for d, t in rows]


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for limit in (3000, 20_000, 1 << 30):
        got = S.shard(docs, limit)
        assert sorted((r.doc_id, r.shard_id) for r in got.collect()) == sorted(brute(rows, limit))
        sizes = got.groupBy("shard_id", "shard_part").agg(F.sum(S.text_bytes()).alias("b"), F.count("*").alias("n"))
        assert all(r.b <= limit or r.n == 1 for r in sizes.collect())


def test_a_large_directory_meets_hashes_alone(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(1).join(spark.range(2500)).select("doc_id", "text")).union(odd_docs.select("doc_id", "text")).repartition(3).cache()
    leaves = S.directory(docs.select(S.hash60().alias("h"), S.text_bytes().alias("bytes")), 3000)
    rows = lambda df: sorted((str(r.doc_id), str(r.text), r.shard_id, r.shard_part) for r in df.collect())
    one, many = S.assign(docs, leaves, 3000), S.assign(docs, leaves, 3000, most=0)
    key = lambda r: r[:3]  # noqa: E731  (parts of repeats are numbered as they come)
    assert list(map(key, rows(many))) == list(map(key, rows(one))) and one.columns == many.columns


def test_repeats_over_the_limit(spark):
    docs = spark.createDataFrame([(7, "a" * 100)] * 57 + [(i, "b" * 10) for i in range(20)] + [(8, "c" * 900)], "doc_id long, text string").repartition(3)
    got = S.shard(docs, 350)
    sizes = got.groupBy("shard_id", "shard_part").agg(F.sum(S.text_bytes()).alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= 350 or r.n == 1 for r in sizes) and sum(r.n for r in sizes) == 78
    assert Counter(r.n for r in sizes if r.b == 300) == {3: 19}


def test_odd_rows(spark, odd_docs, no_docs):
    got = S.shard(odd_docs.withColumn("shard_id", F.lit("x")), 1000)
    assert got.count() == odd_docs.count() and got.where("shard_id is null").isEmpty()
    assert S.shard(no_docs).count() == 0
