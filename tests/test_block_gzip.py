import gzip
import random
import zlib

import pytest

from seqtrend.sources import block_gzip, fasta


def packed(data, sizes):
    """``data`` in gzip blocks of these sizes of text, and the empty block at the end."""
    out, at = [], 0
    for n in (*sizes, len(data), 0):
        text, at = data[at : at + n], at + n
        if not text and n:
            continue
        deflate = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
        body = deflate.compress(text) + deflate.flush()
        tail = zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")
        out.append(block_gzip.BLOCK + (len(block_gzip.BLOCK) + 2 + len(body) + 8 - 1).to_bytes(2, "little") + body + tail)
    return b"".join(out)


@pytest.fixture
def many_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("sep", ["\n", "\n>", "abc"])
def test_as_the_text_source(spark, tmp_path, many_splits, sep):
    rng = random.Random(len(sep))
    (tmp_path / "packed").mkdir()
    (tmp_path / "plain").mkdir()
    for name in range(3):
        pieces = ["".join(rng.choices("aü>b\r 😀", k=rng.choice([0, 1, 30, 900]))).replace("abc", "") for _ in range(400)] + ["z" * 20_000, "end"]
        data = (sep.join(pieces) + (sep if name == 1 else "")).encode()
        blocks = [rng.randint(1, 400) for _ in range(2000)]
        (tmp_path / "packed" / f"{name}.bgz").write_bytes(packed(data, blocks))
        (tmp_path / "plain" / f"{name}.txt").write_bytes(data)
        assert gzip.decompress((tmp_path / "packed" / f"{name}.bgz").read_bytes()) == data
    (tmp_path / "packed" / "empty.bgz").write_bytes(packed(b"", []))
    got = block_gzip.read_block_gzip(spark, str(tmp_path / "packed"), sep)
    want = spark.read.text(str(tmp_path / "plain"), lineSep=sep)
    assert sorted(r.value for r in got.collect()) == sorted(r.value for r in want.collect())
    assert spark.read.option("lineSep", "x").text(str(tmp_path / "packed")).rdd.getNumPartitions() > 20


def test_fasta_in_blocks(spark, tmp_path, many_splits):
    rng = random.Random(7)
    records = [(f"r{i}", "".join(rng.choices("ACDE", k=rng.randint(1, 300)))) for i in range(500)]
    text = "".join(f">{name} x\n{seq[:60]}\n{seq[60:]}\n" for name, seq in records)
    (tmp_path / "a.bgz").write_bytes(packed(text.encode(), [997] * 400))
    assert sorted((r.header, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "a.bgz")).collect()) == sorted(records)
    (tmp_path / "h.bgz").write_bytes(packed(b">U_1 Some name n=3 Tax=T TaxID=9 RepID=R_1\nACD\n", [20]))
    assert [r.id for r in fasta.read_cluster_headers(spark, str(tmp_path / "h.bgz")).collect()] == ["U_1"]


def test_damage(spark, tmp_path):
    good = packed(b"some text\n" * 50, [100] * 4)
    for i, bad in enumerate((good[:-40], gzip.compress(b"plain"), good[:30] + b"\x00" + good[31:])):
        (tmp_path / f"{i}.bgz").write_bytes(bad)
        with pytest.raises(Exception):
            block_gzip.read_block_gzip(spark, str(tmp_path / f"{i}.bgz")).collect()
