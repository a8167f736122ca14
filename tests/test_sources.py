import pytest
from pyspark.sql import functions as F

from seqtrend.sources import clusters, fasta, tables
from seqtrend.streaming.refresh import streaming_period_counts


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one|x first\nACD\nEF\n>two second\n>three\nGH \n")
    rows = {(r.header, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {("one|x", "ACDEF"), ("three", "GH")}
    assert {r.header for r in fasta.read_fasta(spark, str(tmp_path / "a.fa"), "|").collect()} == {"one", "three"}
    names = spark.createDataFrame([("one",), ("four",)], "name string")
    found, missing = fasta.select_records(fasta.read_fasta(spark, str(tmp_path / "a.fa")), names)
    assert [r.sequence for r in found.collect()] == ["ACDEF"] and [r.name for r in missing.collect()] == ["four"]
    fasta.write_fasta(spark.createDataFrame([("", "AC"), ("A1C,C2D", "CD"), ("A1C,C2D", "CE")], "m string, seq string"), str(tmp_path / "out"))
    back = {(r.header, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert {h.lstrip(">") for h, _ in back} == {"REF_0", "A1C_C2D_0", "A1C_C2D_1"}


def test_cluster_headers(spark):
    good = ">UniRef50_A0A5 Uncharacterized protein n=3 Tax=Some virus sp. TaxID=12 RepID=A0A5_VIRU"
    rows = fasta.parse_cluster_headers(spark.createDataFrame([(good,), ("ACD",)], "value string")).collect()
    assert rows[0].asDict() == {"id": "UniRef50_A0A5", "name": "Uncharacterized protein", "size": 3, "taxonomy": "Some virus sp.", "taxonomy_id": "12", "representative": "A0A5_VIRU"}
    with pytest.raises(Exception, match="bad header"):
        fasta.parse_cluster_headers(spark.createDataFrame([(">nothing",)], "value string")).collect()


def test_cluster_xml(spark, tmp_path):
    member = lambda a, b: f'<dbReference type="UniProtKB ID" id="x"><property type="UniRef100 ID" value="{a}"/><property type="UniRef90 ID" value="{b}"/></dbReference>'
    (tmp_path / "c.xml").write_text(f'<all><entry id="C1"><representativeMember>{member("A", "a")}</representativeMember><member>{member("B", "b")}</member></entry><entry id="C2"><representativeMember>{member("D", "d")}</representativeMember></entry></all>')
    entries = clusters.read_cluster_xml(spark, str(tmp_path / "c.xml"))
    assert {(r.cluster, tuple(r.members100), tuple(r.members90)) for r in entries.collect()} == {("C1", ("A", "B"), ("a", "b")), ("C2", ("D",), ("d",))}
    assert {(r.id, r.cluster) for r in clusters.cluster_members(entries, "members90").collect()} == {("a", "C1"), ("b", "C1"), ("d", "C2")}


def test_observations(spark, tmp_path):
    head = "\t".join(tables.RAW)
    rows = ["1\tv1\tHuman\tEurope\t2021-01-02\t\tA\t(Spike_N5Y,Spike_D2G)", "2\tv2\thuman\tAsia\t2021-01\t\tB\t", "3\tv3\tBat\tAsia\t2021-01-02\t\tB\t", "4\tv4\tHuman\tAsia\t2021-01-02\t\tNaN\t"]
    (tmp_path / "o.tsv").write_text("\n".join([head, *rows]) + "\n")
    raw = tables.read_observations(spark, str(tmp_path / "o.tsv"))
    assert raw.count() == 3 and tables.read_observations(spark, str(tmp_path / "o.tsv"), max_rows=2, seed=1).count() == 2
    norm = tables.normalise(raw)
    assert {(r.acc, str(r.d), r.m, r.lineage) for r in norm.collect()} == {("1", "2021-01-02", "D2G,N5Y", "A"), ("2", "2021-01-01", "", "B")}
    tables.write_normalised(norm, str(tmp_path / "n"))
    assert {r.m for r in tables.load_normalised(spark, str(tmp_path / "n")).collect()} == {"D2G,N5Y", ""}
    tables.export_accessions(norm, str(tmp_path / "acc"))
    assert {r.value for r in spark.read.text(str(tmp_path / "acc")).collect()} == {"1", "2"}


def test_samples_and_generations(spark, tmp_path):
    (tmp_path / "run1.json").write_text('{"seq": "AC*", "ll": -1.5}\n{"seq": "AD*", "ll": -2}\n')
    assert {(r.run, r.seq, r.score) for r in tables.read_samples(spark, str(tmp_path / "run1.json")).collect()} == {("run1.json", "AC*", -1.5), ("run1.json", "AD*", -2.0)}
    (tmp_path / "g.json").write_text('{"orig_sequence": "R", "generations": [[{"child": "R"}], [{"parent": "R", "child": "X", "ll": 1.0}, {"parent": "R", "child": "Y"}], [{"parent": "X", "child": "Z"}]]}\n')
    rows = tables.read_generations(spark, str(tmp_path / "g.json")).collect()
    assert {(r.generation, r["rank"], r.parent, r.child) for r in rows} == {(1, 0, "R", "X"), (1, 1, "R", "Y"), (2, 0, "X", "Z")}


def test_reports(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "1.csv").write_text("taxon,lineage\nv1,A\nv2,B\n")
    (tmp_path / "a" / "b" / "2.csv").write_text("taxon,lineage\nv1,C\nv1,D\n")
    (tmp_path / "a" / "x.txt").write_text("taxon,lineage\nv3,C\n")
    assert {(r.taxon, r.lineage) for r in tables.read_assignment_reports(spark, str(tmp_path / "a")).collect()} == {("v1", "D"), ("v2", "B")}


def test_pairs(spark, tmp_path):
    df = spark.createDataFrame([("a", 100.0, f"b{i}", float(i), 3, "train") for i in range(50)] + [("stop", 9.0, "x", 1.0, 1, "val")], "seq0 string, count0 double, seq1 string, count1 double, period int, split string")
    tables.write_pairs(df, str(tmp_path / "p"), max_rows=10)
    back = tables.read_pairs(spark, str(tmp_path / "p"))
    assert back.count() == 10 and tables.filter_pairs(df, min_min=45).count() == 5 and tables.filter_pairs(df, min_max=101).count() == 0


def test_examples(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "val")], "id string, data_type string")
    assert {(r.data_type, r["count"]) for r in tables.write_examples(df, str(tmp_path / "e")).collect()} == {("train", 2), ("val", 1)}


def test_streaming_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2021-01-04", "a"), ("2021-01-05", "a"), ("2021-01-20", "b")], "d string, m string").withColumn("d", F.col("d").cast("date"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming_period_counts(stream).writeStream.outputMode("complete").format("memory").queryName("period_counts").start()
    try:
        query.processAllAvailable()
        got = {(str(r.start), r.m, r.n) for r in spark.sql("select * from period_counts").collect()}
    finally:
        query.stop()
    assert got == {(str(r.start), r.m, r.n) for r in streaming_period_counts(rows).collect()} and sum(n for *_, n in got) == 3


def test_scratch_tables_go_with_their_block(spark, tmp_path):
    import os

    from seqtrend.sources.scratch import scratch_path, scratch_tables, stored

    folder = lambda t: t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    kept = stored(spark.range(3), "outer")
    with scratch_tables(spark):
        one = folder(stored(spark.range(5), "a"))
        with scratch_tables(spark):
            two = folder(stored(spark.range(6), "b"))
            scratch_path(spark, "never-written")
        assert os.path.isdir(one) and not os.path.exists(two)
    assert not os.path.exists(one) and kept.count() == 3
    with pytest.raises(ValueError), scratch_tables(spark):
        three = folder(stored(spark.range(7), "c"))
        raise ValueError
    assert not os.path.exists(three)
