"""Token ids in fixed-width bit packing.

A segment is one binary value: header, document table, block table, packed ids.

    0   4s   magic "TPK1"          4   u1 bits an id, 3 bytes of padding
    8   u4   ids in a block       12   u4 documents
    16  u8   ids                  24   u4 blocks, 4 bytes of padding
    32  i8[documents] doc_id; u1[documents] 1 if the id is null, padded to 8
        u8[documents + 1] place of each document's first id
        u8[blocks + 1] byte offset of each block in the packed ids, from their begin

Id i of a block takes bits [i * bits, (i + 1) * bits) of it, lowest first, so any range of ids is unpacked
with a few numpy operations. Files are Parquet: Spark commits them whole, on any store, also after a lost
executor. A row holds one segment, and ``part`` and ``seq`` put the segments in ascending doc_id order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtrend.llm.common import scratch_path

MAGIC, HEAD, BLOCK = b"TPK1", struct.Struct("<4sB3xIIQI4x"), 4096
SEGMENT_IDS = 1 << 19
CACHED_WORDS = 800_000
WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}  # widths that numpy has as such
SEGMENTS = "part int, seq int, n_docs long, n_ids long, segment binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (below 2**bits, bits <= 32) side by side, each block of BLOCK ids from a new byte on."""
    if bits in WHOLE:
        return ids.astype(WHOLE[bits]).tobytes()
    out = []
    for at in range(0, len(ids), BLOCK):
        planes = (ids[at : at + BLOCK, None].astype("<u4") >> np.arange(bits, dtype="<u4")) & 1
        out.append(np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(block: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """Ids first to last (exclusive) of one packed block (bytes)."""
    if bits in WHOLE:
        return block.view(WHOLE[bits])[first:last].astype("<u4")
    bit = np.arange(first, last, dtype=np.int64) * bits
    byte = bit >> 3
    padded = np.concatenate([block, np.zeros(8, np.uint8)])
    words = np.zeros(len(bit), np.uint64)
    for k in range((bits + 14) // 8):
        words |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    blocks = -(-len(ids) // BLOCK)
    null = np.array([d is None for d in doc_ids], np.uint8)
    payload = pack(ids, bits)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * (BLOCK * bits // 8), len(payload))
    return b"".join([
        HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids), blocks),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), bytes(-len(null) % 8),
        np.concatenate([[0], np.cumsum(counts)]).astype("<u8").tobytes(), offsets.tobytes(), payload,
    ])


class Segment:
    """Random access to one packed segment."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, n, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        ids = np.frombuffer(data, "<i8", n, at)
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        at += 8 * n + n + -n % 8
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 8 * (n + 1)).astype(np.int64)
        self.packed = np.frombuffer(data, np.uint8, offset=at + 8 * (n + 1) + 8 * (blocks + 1))

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last (exclusive) of the segment."""
        out = [np.zeros(0, "<u4")]
        for b in range(first // self.block, -(-last // self.block)):
            low, high = max(first, b * self.block), min(last, (b + 1) * self.block)
            out.append(unpack(self.packed[self.offsets[b] : self.offsets[b + 1]], self.bits, low - b * self.block, high - b * self.block))
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit integers.

    The vocabulary drops white space and its pre-tokens never hold any, so a text's ids are those of its
    parts between ASCII white space. The ids of frequent parts are kept, a bounded number of them.
    """
    tokenizer, kept = _tokenizer(path)

    def encode(text: str) -> bytes:
        words = text.encode().split()
        held = list(map(kept.get, words))
        if None not in held:
            return b"".join(held)
        new = list({w for w, ids in zip(words, held) if ids is None})
        fresh = {}
        for at in range(0, len(new), 512):
            some = [w.decode() for w in new[at : at + 512]]
            found = tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = np.cumsum([len(w) + 1 for w in some])
            cuts = (4 * np.searchsorted(np.array([o[0] for o in found.offsets], np.int64), ends, "left")).tolist()
            for w, a, b in zip(new[at : at + 512], [0, *cuts], cuts):
                fresh[w] = ids[a:b]
        if len(kept) < CACHED_WORDS:
            kept.update(fresh)
        return b"".join([fresh[w] if ids is None else ids for w, ids in zip(words, held)])

    return encode


def _write(path: str, bits: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        docs: list = []
        counts: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [seq], [len(docs)], [len(ids)], [segment(docs, counts, ids, bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["part", "seq", "n_docs", "n_ids", "segment"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                docs.append(doc)
                counts.append(len(ids) // 4)
                held.append(ids)
                total += counts[-1]
                if total >= SEGMENT_IDS:
                    yield flush()
                    seq, total = seq + 1, 0
                    docs.clear(), counts.clear(), held.clear()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every text (null: empty), append ``end_id`` to it, and write segments in ascending doc_id order.

    Null ids come first. Ties of an id are ordered by their text's hash, then as they come, so repeats need not
    share a task; each repeated row is a document of its own. Very long texts are encoded whole. An empty table
    gives files without segments. Other columns, whatever their names, are left out.
    """
    bits = max(1, (_tokenizer(tokenizer)[0].get_vocab_size() - 1).bit_length())
    order = ["doc_id", "_llm_text", "_llm_row"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_llm_text"), F.monotonically_increasing_id().alias("_llm_row"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows.mapInArrow(_write(tokenizer, bits, end_id), SEGMENTS).write.option("parquet.enable.dictionary", "false").mode("overwrite").parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("segment")):
            held = Segment(data.as_py())
            ids = held.ids(0, held.n_ids)
            edges = held.starts.tolist()
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held.doc_ids, pa.int64()), pa.array(held.starts[:-1] + start), pa.array(np.diff(held.starts)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    Starts are running sums in two steps: over the parts (one row a file), then over each part's segments.
    """
    files = spark.read.schema(SEGMENTS).parquet(out)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(upto(Window.orderBy("part"))), F.lit(0)).alias("part_start"))
    within = F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    starts = files.select("part", "seq", within.alias("seq_start")).join(F.broadcast(parts), "part")
    starts = starts.select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("start"))
    # One row a segment of half a million ids: far smaller than the files, and checked before a broadcast.
    starts = F.broadcast(starts) if files.count() <= 1_000_000 else starts
    return files.join(starts, ["part", "seq"]).select("start", "segment").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), out, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, out)
