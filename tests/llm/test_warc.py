import base64
import gzip
import hashlib
import io
import random

import pytest

from seqtrend.llm import warc as W

SCHEMA = "page_id long, url string, html string, ts string, record string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every row, by payload."""
    out, groups = [], {}
    for page, url, html in rows:
        groups.setdefault(html or "", []).append((page is not None, page or 0, url is not None, url or "", page))
    for html, held in groups.items():
        held.sort(reverse=True)
        small = len(html.encode()) < least
        for i, (*_, page) in enumerate(held):
            first = i == 0 or small
            out.append((page, len(html.encode()), digest(html), "response" if first else "revisit", None if first else held[0][-1]))
    return out


def shape(rows):
    return sorted(rows, key=str)


ODD = [
    (1, "http://www.Example.com:80/a?b=1#c", "<p>one</p>"), (2, "https://example.com/a?b=1", "<p>one</p>"), (2, "https://example.com/a?b=1", "<p>one</p>"),
    (3, None, None), (4, "ftp://user@sub.example.com", ""), (None, "x y\r\nWARC-Type: fake", None), (None, None, "<p>one</p>"), (5, "no scheme", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "http://a.b/ü", "ü😀\x00\r\n\r\nWARC/1.1\r\n"), (7, "http://a.b/long", "long " * 200_000), (-8, "http://a.b/", "\r\n\r\n"), (9, "http://a.b/", "\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "t", "r") for r in ODD], SCHEMA).repartition(3)


@pytest.mark.parametrize("least", [0, 2, 11])
def test_round_trip(spark, odd, tmp_path, least):
    W.write_archives(odd, f"file://{tmp_path}/a", least_bytes=least)
    got = W.merge_index(W.read_archives(spark, f"file://{tmp_path}/a"), range_rows=4).orderBy("place").collect()
    assert shape((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == shape(brute(ODD, least))
    assert [r.place for r in got] == list(range(1, len(ODD) + 1))
    keys = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0, r.record_type) for r in got]
    assert keys == sorted(keys)
    assert {r.url_key for r in got if r.page_id in (1, 2)} == {"com,example)/a?b=1"}
    # A capture is found again by its archive, offset and length.
    for r in got:
        with gzip.open(r.run.removeprefix("file:")) as f:
            f.seek(r.offset)
            (one,) = W.parse(io.BytesIO(f.read(r.length)))
        assert (one["page_id"], one["payload_digest"], one["url"]) == (r.page_id, r.payload_digest, r.url)


def test_query_on_given_pages(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = W.op12(spark, sf).collect()
    assert shape(tuple(r)[:5] for r in got) == shape(brute(rows))


def test_archives_are_sorted_runs_of_bounded_size(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    W.write_archives(pages, f"file://{tmp_path}/a", run_bytes=10_000)
    runs = W.read_archives(spark, f"file://{tmp_path}/a").orderBy("run", "place_in_run").collect()
    held = {}
    for r in runs:
        held.setdefault(r.run, []).append((r.url_key, r.ts, r.page_id))
    assert len(held) > 8 and all(v == sorted(v) for v in held.values())
    total = sum(r.payload_bytes for r in runs if r.record_type == "response")
    assert len(held) >= total / 20_000


def test_no_pages_and_damage(spark, odd, tmp_path):
    W.write_archives(odd.limit(0), f"file://{tmp_path}/none")
    assert W.merge_index(W.read_archives(spark, f"file://{tmp_path}/none")).count() == 0
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabd"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest('abc')}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    for damaged in (head + body + b"\r\n\r\n", (head + body)[:-2], b"x\r\n", head[:30]):
        with pytest.raises(ValueError):
            list(W.parse(io.BytesIO(damaged)))


def test_one_hot_payload_and_address(spark, tmp_path):
    rows = [(i, "http://hot.example/", "the same") for i in range(3000)] + [(i, f"http://h.example/{i % 7}", f"body {i}") for i in range(3000, 3300)]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    index = W.merge_index(W.read_archives(spark, f"file://{tmp_path}/a"), range_rows=500)
    got = index.orderBy("place").collect()
    assert shape((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == shape(brute(rows))
    assert [r.place for r in got] == list(range(1, 3301)) and [r.page_id for r in got if r.url_key == "example,hot)/"] == list(range(3000))
    sizes = index.groupBy("range").count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 1500  # the hot address is cut by time


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(20), rng.randrange(5)) for _ in range(rng.choice([0, 1, 17, 60]))) for _ in range(k)]
        assert list(W.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
