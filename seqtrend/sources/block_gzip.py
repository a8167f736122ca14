"""Text in gzip blocks (BGZF, files named .bgz): a large file is read by as many tasks as it has splits.

Every block begins with the same 16 bytes, so the text source, with these as the separator, gives one block a
row from any split of a file. A task unpacks the blocks of its splits and cuts them at the separator of the
records; what hangs over at either end of a split is put together in a small table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: the begin of a block, up to the two bytes of its size.
BLOCK = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
FOUND = "path string, start long, head binary, tail binary, record binary"


def unpacked(row: bytes) -> bytes:
    """The text of a block from what follows BLOCK: two bytes of size, the data, their checksum and length."""
    size = int.from_bytes(row[:2], "little") + 1
    if size != len(row) + len(BLOCK):
        raise ValueError("not a gzip block, or one that is cut off")
    text = zlib.decompress(row[2:-8], -zlib.MAX_WBITS)
    if zlib.crc32(text) != int.from_bytes(row[-8:-4], "little"):
        raise ValueError("the block's checksum differs")
    return text


def _pieces(sep: bytes, rows: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, head, rest = None, None, b""

        def out() -> pa.RecordBatch:
            columns = list(zip(*held)) or [[]] * 5
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), *[pa.binary()] * 3))], ["path", "start", "head", "tail", "record"])

        for batch in batches:
            for path, start, block in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "block"))):
                if (path, start) != at:
                    if at:
                        held.append((*at, *((rest, None) if head is None else (head, rest)), None))
                    at, head, rest = (path, start), None, b""
                if not block:  # nothing stands before a file's first block
                    continue
                *whole, rest = (rest + unpacked(block)).split(sep)
                if whole and head is None:
                    head, *whole = whole
                held += [(path, start, None, None, record) for record in whole]
                if len(held) >= rows:
                    yield out()
        if at:
            held.append((*at, *((rest, None) if head is None else (head, rest)), None))
        yield out()

    return run


def read_block_gzip(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """(value): the pieces of text between separators, as the text source gives them for files that aren't packed.

    Pieces may be empty, but for the last of a file. Other gzip files, which have no such blocks, are an error.
    """
    blocks = spark.read.option("lineSep", BLOCK.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    blocks = blocks.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("block"))
    found = blocks.mapInArrow(_pieces(sep.encode()), FOUND)
    inner = found.where("record is not null").select(F.col("record").cast("string").alias("value"))
    # A row a split: a record ends in the first split, after that of its begin, that has a separator.
    ends = found.where("head is not null")
    along = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum(F.col("tail").isNotNull().cast("int")).over(along), F.lit(0)))
    parts = F.array(F.struct(F.col("_before").alias("g"), F.lit(0).alias("i"), F.col("head").alias("piece")), F.struct((F.col("_before") + 1).alias("g"), F.lit(1).alias("i"), F.col("tail").alias("piece")))
    parts = ends.select("path", "start", F.explode(parts).alias("p")).where("p.piece is not null").select("path", "p.g", F.struct("start", "p.i", "p.piece").alias("s"))
    joined = parts.groupBy("path", "g").agg(F.array_sort(F.collect_list("s")).alias("s"))  # as many as a record spans splits
    text = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["piece"])).cast("string")
    last = F.col("g") == F.max("g").over(Window.partitionBy("path"))
    # Where a separator itself was cut, the text put together holds it again.
    lists = joined.select(F.split(text, re.escape(sep) if sep.isprintable() else "".join(f"\\x{b:02x}" for b in sep.encode()), -1).alias("v"), last.alias("last"))
    whole = F.when(F.col("last") & (F.element_at("v", -1) == ""), F.slice("v", F.lit(1), F.size("v") - 1)).otherwise(F.col("v"))
    return inner.union(lists.select(F.explode(whole).alias("value")))
