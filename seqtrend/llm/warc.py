"""Web archives with an index in global order: sorted runs of captures, merged by a loser tree.

Every task writes archives of WARC records whose captures are sorted by URL key and timestamp: sorted runs.
Reading an archive back gives its run of the index. The keys are cut into ranges; one task a range takes its
slice of every run and merges the slices by a loser tree, so that the ranges one after another hold all
captures of a URL side by side, in order of time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtrend.llm.common import join_counted, small, stored
from seqtrend.sources.scratch import scratch_path

#: Payload bytes of an archive, on average; captures that one task merges, about; bytes of a revisit, roughly.
RUN_BYTES = 128 << 20
RANGE_ROWS = 500_000
REVISIT_BYTES = 1_000
FIRST_SECOND, SECONDS = 1_577_836_800, 1_000_000_000  # from 2020-01-01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values of the format.
BASE32 = UPPER + "234567"
VERSION, NEWLINE, END = "WARC/1.1", "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "url string, ts string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, run string, place_in_run long, offset long, length long"
FIELDS = [f.split()[0] for f in RECORD.split(", ")]


def one_line(url: Column) -> Column:
    """A URL without blanks and control characters, which would end its line in the archive."""
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")


def url_key(url: Column) -> Column:
    """Sort key of a URL: the host's labels from the last to the first, then path and query; empty for a null URL.

    Scheme, user, ``www.``, a default port and the fragment are left out, and the host is in small letters.
    """
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#@]*@)?", "")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"#[\s\S]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), path), F.lit(""))


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 8 pieces of 20 bits, each 4 digits of 5 bits."""
    digit = lambda bits, s: F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    piece = lambda sha, i: F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
    pieces = lambda sha: F.transform(F.array(*[piece(sha, i) for i in range(8)]), lambda bits: F.concat(*[digit(bits, s) for s in (15, 10, 5, 0)]))
    return F.array_join(F.flatten(F.transform(F.array(F.sha1(payload)), pieces)), "")


def utc(seconds: Column) -> Column:
    """Seconds since 1970 as an ISO date in UTC, whatever the session's time zone."""
    return F.concat(F.replace(F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz")).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def page_second(page_id: Column) -> Column:
    """The second of a capture where the table has none: a second a page, in the order of the ids."""
    return F.lit(FIRST_SECOND) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(SECONDS))


def captures(pages: DataFrame, second: Column | None = None) -> DataFrame:
    """(page_id, url, date, html, same, digest, bytes): what an archive needs of a page; ``same`` tells payloads apart."""
    page_id = F.col("page_id").cast("long")
    date = utc((second if second is not None else page_second(page_id)).cast("long"))
    rows = pages.select(page_id.alias("page_id"), one_line(F.col("url").cast("string")).alias("url"), date.alias("date"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.select("*", F.sha2("html", 256).alias("same"), sha1_base32(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))


def decided(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Captures without payload, with ``response`` and the first_page, first_url, first_date of what a revisit refers to.

    Of a payload's captures that of the largest page_id is the response, ties going to the larger URL, then to
    the later date; of equal captures it is copy 1. A payload below ``least_bytes`` is always a response.
    Equal captures are counted before payloads meet, and payloads of many captures are joined by broadcast.
    """
    id_ = ["page_id", "url", "date"]
    keys = stored(rows.groupBy("same", *id_, "digest", "bytes").agg(F.count("*").alias("copies")), "captures")
    last = keys.groupBy("same").agg(F.max(F.struct(*id_)).alias("last"), F.count("*").alias("n"))
    out = join_counted(keys, last, ["same"]).drop("n").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    whole = ((F.struct(*id_) == F.col("last")) & (F.col("copy") == 1)) | (F.col("bytes") < least_bytes)
    return out.select("same", *id_, "digest", "bytes", "copy", whole.alias("response"), F.col("last.page_id").alias("first_page"), F.col("last.url").alias("first_url"), F.col("last.date").alias("first_date"))


def _record_id(page: Column, url: Column, date: Column, copy: Column) -> Column:
    parts = F.concat_ws("\n", F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-")), date, copy.cast("string"))
    return F.concat(F.lit("<urn:sha1:"), F.sha1(parts.cast("binary")), F.lit(">"))


def record_text() -> Column:
    """A WARC record, without the two line ends behind it, from the columns of ``decided`` and html."""
    revisit = ~F.col("response")
    line = lambda name, value, where=F.lit(True): F.when(where, F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(NEWLINE)))
    header = lambda first, *lines: F.concat(F.lit(first + NEWLINE), *[F.coalesce(x, F.lit("")) for x in lines], F.lit(NEWLINE))
    http = header("HTTP/1.1 200 OK", line("Content-Type", F.lit("text/html; charset=UTF-8")), line("Content-Length", F.col("bytes")))
    body = F.when(revisit, "").otherwise(F.col("html"))
    head = header(
        VERSION,
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(*map(F.col, ("page_id", "url", "date", "copy")))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("Page-ID", F.col("page_id")),
        line("WARC-Profile", F.lit(REVISIT_PROFILE), revisit),
        line("WARC-Refers-To", _record_id(*map(F.col, ("first_page", "first_url", "first_date")), F.lit(1)), revisit),
        line("WARC-Refers-To-Target-URI", F.col("first_url"), revisit),
        line("WARC-Refers-To-Date", F.col("first_date"), revisit),
        line("Refers-To-Page-ID", F.col("first_page"), revisit),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(http) + F.octet_length(body)),
    )
    return F.concat(head, http, body)


def write_archives(pages: DataFrame, path: str, second: Column | None = None, least_bytes: int = 0, run_bytes: int = RUN_BYTES) -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) to gzip archives below ``path``.

    Each archive is sorted by URL key, date and page_id. A payload goes through one shuffle, once however many
    captures it has; revisits hold the HTTP header alone. Null html is an empty payload, a null url or page_id
    leaves its line out, blanks and control characters in a URL become %20; repeated rows are captures of
    their own. ``second`` is the time of a capture in seconds since 1970. Other columns are left out. An empty
    table gives no archive.
    """
    spark = pages.sparkSession
    rows = captures(pages, second)
    every = stored(decided(rows, least_bytes), "decided")
    # One body a payload. Small payloads, which may have many responses, are the only ones that can be hot.
    often = F.when(F.first("bytes") < least_bytes, F.count("*")).otherwise(1)
    bodies = rows.groupBy("same").agg(F.first("html").alias("html"), often.alias("n"))
    if least_bytes:
        bodies = stored(bodies, "bodies")
        responses = join_counted(every.where("response"), bodies, ["same"]).drop("n")
    else:
        responses = every.where("response").join(bodies.drop("n"), "same")
    whole, parts = F.expr("sum(if(response, bytes, 0))"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, revisits = every.agg(F.coalesce(whole, F.lit(0)), F.count_if(~F.col("response"))).first()
    # Archives by the hash that dealt the bodies: a task writes as many as its share of the bytes needs, also where
    # partitions were put together. Revisits are dealt otherwise, and have archives of their own.
    runs, each = -(-total // run_bytes) or 1, -(-revisits * REVISIT_BYTES // (run_bytes * parts)) or 1
    dealt = F.pmod(F.hash("same"), F.lit(parts * -(-runs // parts)))
    responses = responses.withColumn("_slot", dealt if runs > parts else F.pmod(F.pmod(F.hash("same"), F.lit(parts)), F.lit(runs)))
    rest = every.where("not response").withColumn("html", F.lit("")).withColumn("_slot", F.pmod(F.hash("page_id", "url", "copy"), F.lit(each)))
    both = responses.unionByName(rest)
    key = ["_slot", "_key", "date", "page_id", "copy"]
    out = both.withColumn("_key", url_key(F.col("url"))).sortWithinPartitions(*key).select("_slot", record_text().alias("record"))
    out.write.partitionBy("_slot").option("lineSep", END).option("compression", "gzip").text(path)


def parse(stream) -> Iterator[dict]:
    """The records of an archive, their lengths and digests checked; offsets are those of the text before compression."""
    offset = place = 0
    while start := stream.readline():
        if start != (VERSION + NEWLINE).encode():
            raise ValueError(f"no record at {offset}")
        head, size = {}, len(start)
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"the header at {offset} is cut off")
            name, _, value = line.decode().partition(": ")
            head[name], size = value.removesuffix(NEWLINE), size + len(line)
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]) or stream.read(4) != END.encode():
            raise ValueError(f"the record at {offset} is cut off")
        size += 2 + len(block) + 4
        http, _, payload = block.partition(END.encode())
        n = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
        if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"the payload at {offset} is not what its digest says")
        number = lambda name: int(head[name]) if name in head else None  # noqa: E731, B023
        yield {
            "url": head.get("WARC-Target-URI"), "ts": "".join(filter(str.isdigit, head["WARC-Date"])), "page_id": number("Page-ID"), "record_type": kind,
            "payload_digest": digest, "payload_bytes": n, "refers_to": number("Refers-To-Page-ID"), "place_in_run": place, "offset": offset, "length": size,
        }
        offset, place = offset + size, place + 1


def _parsed(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in RECORD.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            held = []
            # The archive is decompressed as it is read: one record is in memory at a time.
            for record in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                held.append(record | {"run": path.as_py()})
                if len(held) == rows:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The sorted runs of the index: a row per record with its URL key, archive (run) and place there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(_parsed, RECORD).select(url_key(F.col("url")).alias("url_key"), *FIELDS)


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so a new head plays only on its way to the top."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.heads = runs, [next(r, None) for r in runs]
        self.losers, self.winner = [-1] * len(runs), -1
        for leaf in range(len(runs)):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """An exhausted run loses; equal heads come in the order of the runs."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        node = (leaf + len(self.runs)) // 2
        while node:
            held = self.losers[node]
            if held < 0:  # the first to come waits for its opponent
                self.losers[node] = leaf
                return
            if self._beats(held, leaf):
                self.losers[node], leaf = leaf, held
            node //= 2
        self.winner = leaf

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._play(self.winner)


def _merged(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """One range: its slices of the runs, each in the order of its run, merged."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by([("run", "ascending"), ("place_in_run", "ascending")]).combine_chunks()
    keys, runs = [table.column(c).to_pylist() for c in ("url_key", "ts", "page_id", "record_type")], table.column("run").to_pylist()
    begins = [i for i in range(len(runs)) if i == 0 or runs[i] != runs[i - 1]]

    def slice_of(begin: int, end: int) -> Iterator[tuple]:
        for i in range(begin, end):
            url, ts, page, kind = (c[i] for c in keys)
            yield url, ts, page is not None, page or 0, kind, i

    order = [head[-1] for head in LoserTree([slice_of(a, b) for a, b in zip(begins, [*begins[1:], len(runs)])])]
    number = TaskContext.get().partitionId()
    for at in range(0, len(order), rows):
        part = table.take(pa.array(order[at : at + rows]))
        n = len(part)
        part = part.append_column("range", pa.array([number] * n, pa.int32())).append_column("place_in_range", pa.array(range(at, at + n), pa.int64()))
        yield from part.combine_chunks().to_batches()


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in order of URL key, timestamp and page_id, null ids first: ``place`` numbers them from 1.

    A range holds about ``range_rows`` captures, also where they are all of one URL, for ranges are cut by the
    whole key. Equal captures come responses first, then in the order of their runs.
    """
    runs = stored(runs, "runs")
    n = -(-runs.count() // range_rows) or 1
    cut = runs.repartitionByRange(n, "url_key", "ts", "page_id", "record_type", "run", "place_in_run")
    merged = stored(cut.mapInArrow(_merged, f"url_key string, {RECORD}, range int, place_in_range long"), "index")
    sizes = merged.groupBy("range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = small(sizes.select("range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return merged.join(sizes, "range").withColumn("place", F.col("_before") + F.col("place_in_range") + 1).drop("_before", "place_in_range", "place_in_run")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    index = merge_index(read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "place")


def _op12_sql() -> str:
    digits = " || ".join(f"substr('{BASE32}', (('0x' || substr(sha, {5 * i + 1}, 5))::INT >> {s}) % 32 + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return rf"""
WITH p AS (
  SELECT page_id, regexp_replace(url, '[\x00-\x20\x7F]', '%20', 'g') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
u AS (
  SELECT *, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#@]*@)?', '') AS rest,
    row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY html) AS last FROM p),
h AS (
  SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '#[\s\S]*', '') AS path FROM u),
k AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {digits} AS payload_digest,
    CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN last END AS refers_to,
    coalesce(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path, '') AS url_key,
    strftime(make_timestamp(({FIRST_SECOND} + (coalesce(page_id, 0) % {SECONDS} + {SECONDS}) % {SECONDS}) * 1000000), '%Y%m%d%H%M%S') AS ts FROM h)
SELECT *, row_number() OVER (ORDER BY url_key, ts, page_id NULLS FIRST, record_type) AS place FROM k
"""


OP12_SQL = _op12_sql()
