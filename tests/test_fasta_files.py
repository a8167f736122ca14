from seqtrend.plans import files
from seqtrend.sources import fasta


def test_records_are_written_compressed_by_many_tasks(spark, tmp_path, monkeypatch):
    """equal sequences cost little disk, and no one task writes or reads all records."""
    monkeypatch.setattr(files, "scratch_path", lambda s, name: str(tmp_path / name))
    monkeypatch.setattr(fasta, "FILE_RECORDS", 1_000)
    rows = files.s2_s10_fasta(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() == len({r.header for r in rows})
    parts = list((tmp_path / "fasta").glob("part-*"))
    assert len(parts) >= 6 and all(p.name.endswith(".gz") for p in parts) and sum(p.stat().st_size for p in parts) < 40 * len(rows)
