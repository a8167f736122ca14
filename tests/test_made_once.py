"""Costly columns are made once a row: counted in the plans that Spark runs."""

import time

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from seqtrend.functions import mutations, tokens
from seqtrend.operators import audit, pairs, ranks
from seqtrend.plans import files
from seqtrend.plans.files import job_make_corpus
from seqtrend.plans.queries import QUERIES
from seqtrend.sources import fasta, tables
from seqtrend.sources.scratch import stored


def made(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


@pytest.mark.parametrize("name", ["f18_masked_example", "f15_pool_form", "f19_tile_masks"])
def test_texts_are_cleaned_once(spark, sf, name):
    assert made(QUERIES[name](spark, sf), "regexp_replace(") == 1


def test_pieces_are_masked_once(spark, sf):
    assert made(job_make_corpus(spark, sf), "reverse(") == 1


def test_text_is_reversed_once(spark):
    rows = spark.createDataFrame([("AABCDAIGHACGACGAABHGAIGH",), ("",), ("A",), (None,), ("AA",)], "seq string").coalesce(1)
    out = rows.select(tokens.anchor_length("seq", suffix=True, longest=16).alias("n"), tokens.anchor_length("seq", longest=16).alias("p"))
    assert made(out, "reverse(") == 1
    assert [(r.p, r.n) for r in out.collect()] == [(4, 5), (None, None), (1, 1), (None, None), (2, 2)]


def test_chunks_take_time_in_proportion(spark):
    rows = spark.range(1).select(F.concat(F.repeat(F.lit("ACDEFGHIKL"), 200_000), F.lit("*")).alias("seq"))
    begin = time.time()
    out = tokens.chunk_sequence(rows, 500).agg(F.count("*"), F.max("fragment"), F.sum(F.length("piece"))).first()
    assert tuple(out) == (4000, 3999, 2_000_000) and time.time() - begin < 20


def test_tiles_beyond_a_group_of_steps(spark):
    """Tiles follow each other to the end, over many groups of steps, none but the last beyond it."""
    rows = spark.range(1).select(F.repeat(F.lit("ACDEFGHIKL"), 100).alias("seq"))
    out = rows.select(F.explode(tokens.tiles("seq", 3, 0, 2)).alias("t")).select("t.*").collect()
    assert len(out) > 8 * tokens.STEPS
    assert all(a.mask_start + a.mask_length == b.mask_start and a.mask_length + b.mask_length > 0 for a, b in zip(out, out[1:]))
    assert out[0].mask_start == 0 and out[-1].mask_start < 1000 <= out[-1].mask_start + out[-1].mask_length


def test_records_are_cut_once(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\n AC \r\nGT\n>two\n\n>three\nA\n")
    out = fasta.read_fasta(spark, str(tmp_path))
    assert made(out, "split(") == 1 and made(out, "array_join(") == 1
    assert sorted(map(tuple, out.collect())) == [("one", "ACGT"), ("three", "A")]


def test_few_keys_are_dealt_to_several_tasks(spark):
    """Adaptive plans join small parts of a shuffle to one task, which then made all alignments."""
    rows = spark.range(64).select(F.concat(F.lit("A1"), F.col("id").cast("string")).alias("m"))
    out = mutations._mapped(rows, ["m"], "at", "int", lambda m: TaskContext.get().partitionId())
    assert out.distinct().count() == 64 and out.select("at").distinct().count() > 1


def test_longest_key_is_found_among_the_distinct(spark, sf):
    """Every row was cut into units: the distinct below a maximum is left out."""
    plan = QUERIES["f12_f13_alignment_and_distance"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_suppkey" not in plan


def test_texts_without_ambiguity_are_not_compared_by_place(spark):
    text = F.concat(F.repeat(F.lit("ACDEFGHIKL"), 1000), F.col("id").cast("string"))
    rows = spark.range(20_000).coalesce(1).select(text.alias("a"), F.concat(F.repeat(F.lit("ACDEFGHIKL"), 1000), (F.col("id") + F.col("id") % 2).cast("string")).alias("b"))
    begin = time.time()
    out = rows.agg(F.count_if(mutations.verify_sequence("a", "b")).alias("v"), F.count_if(mutations.compatible("a", "b")).alias("c")).first()
    assert tuple(out) == (10_000, 10_000) and time.time() - begin < 10


def test_accession_in_either_spelling_and_several_records(spark):
    obs = spark.createDataFrame([("EPI_ISL_1", "A1C", 1), ("1", "", 2), ("2", "A1C", 3), (None, "", 4), ("3", None, 5), ("3", "", 6)], "acc string, m string, k int")
    records = spark.createDataFrame([("x|EPI_ISL_1|", "AC*"), ("x|EPI_ISL_1|y", "XC*"), ("x|EPI_ISL_2", "AC*"), ("none", "AC*"), ("x|EPI_ISL_3", None)], "header string, sequence string")
    out = audit.label_reconstruction(obs, records, "AC*")
    assert out.columns == ["acc", "m", "k", "reconstructed"]
    assert {r.k: r.reconstructed for r in out.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert made(out, "regexp_extract(") == 1


def _all_in_one_week(spark, n):
    counts = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda w: (F.lit(10.0) + F.col("id")) * (w + 1))
    rows = spark.range(n).select(F.concat(F.lit("A"), F.col("id").cast("string"), F.lit("C")).alias("m"), F.lit(0).alias("week"), counts.alias("counts"))
    return stored(rows.withColumn("total", F.element_at("counts", -1)), "series")


def test_pairs_of_one_week_are_made_by_several_tasks(spark):
    """A week's few thousand rows are some bytes and millions of pairs."""
    series = _all_in_one_week(spark, 2_500)
    made = pairs.week_band_pairs(series, 20, with_weekly=True).select("seq0", "weekly_counts1", F.spark_partition_id().alias("p"))
    tasks = {r.p: r.n for r in made.groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert sum(tasks.values()) == 2_500 * 2_499 // 2 and len(tasks) > 1


def test_pairs_carry_no_series_through_a_shuffle(spark, monkeypatch):
    series = _all_in_one_week(spark, 30)
    few = pairs.week_band_pairs(series, 20, with_weekly=True)
    checked = pairs.validate_pairs(few.select("seq0", "count0", "seq1", "count1", "period"), series, series, max_p_diff=1.0)
    assert few._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 2
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 4
    monkeypatch.setattr(pairs, "SERIES_COUNTS", 0)
    many = pairs.week_band_pairs(series, 20, with_weekly=True)
    again = pairs.validate_pairs(many.select("seq0", "count0", "seq1", "count1", "period"), series, series, max_p_diff=1.0)
    for x, y in ((few, many), (checked, again)):
        assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect())) and x.count() == 30 * 29 // 2


def test_only_the_ids_that_are_held_are_made(spark, sf):
    """Texts are looked through as a whole, but not encoded beyond what a model's input holds."""
    rows = spark.createDataFrame([("ACDA*",), ("A*",)], "s string")
    assert [r.x for r in rows.select(tokens.encode("s", 4).alias("x")).collect()] == [[26, 0, 1, 2], [26, 0, 27]]
    with pytest.raises(Exception, match="no letter: 1"):
        spark.createDataFrame([("ACDAAA1A*",)], "s string").select(tokens.encode("s", 3)).collect()
    long = spark.range(1).select(F.concat(F.repeat(F.lit("ACDEFGHIKL"), 200), F.lit("*")).alias("s"))
    held = long.select(tokens.pad_or_crop("s", 11, F.lit(13)).alias("x")).first().x.input_ids
    assert held == [26, *range(3, 10), 0, 1, 2]
    assert made(QUERIES["f15_pool_form"](spark, sf), ", 1, 511)") >= 1


def test_tiles_take_time_in_proportion(spark):
    rows = spark.range(1).select(F.repeat(F.lit("ACDEFGHIKL"), 200_000).alias("seq"))
    begin = time.time()
    last = rows.select(F.element_at(tokens.tiles("seq", 3, 0, 128), -1).alias("t")).first().t
    assert last.mask_start < 2_000_000 <= last.mask_start + last.mask_length and time.time() - begin < 20


def test_examples_are_in_the_order_of_their_files(spark, sf):
    """A write by split sorted the examples, many times as wide as the pieces that they are made of."""
    plan = job_make_corpus(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [data_type" in plan
    written = files._corpus(spark, sf)._jdf.queryExecution().optimizedPlan()
    assert "data_type" in written.outputOrdering().toString()


def test_parts_beyond_the_first_rows_are_not_shuffled(spark):
    """All pairs of a split were shuffled and sorted for some hundred random ones."""
    rows = spark.range(200_000).select(F.concat(F.lit("a"), "id").alias("k"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("by"))
    kept = tables.cap_rows(rows, 50, 7, "by", ["k"])
    plain = ranks.random_rank(rows, 7, ["k"], "_rn", ("by",)).where("_rn <= 50").select("k", "by")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, plain.collect())) and kept.count() == 100
    assert "strategy=broadcast" in kept._jdf.queryExecution().optimizedPlan().toString()
    few = ranks.random_rank(rows, 7, ["k"], "rn", most=7)
    assert sorted(r.rn for r in few.collect()) == list(range(1, 8))
    assert tables.cap_rows(rows.limit(5), 50, 7, "by", ["k"]).count() == 5


def test_tables_are_tested_by_several_tasks(spark, monkeypatch):
    series = _all_in_one_week(spark, 40)
    made = pairs.week_band_pairs(series, 20)
    checked = pairs.validate_pairs(made, series, series, p_value=0.5)
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [xxhash64(_a0" in plan


def test_known_mutations_are_cut_once_a_variant(spark):
    known = spark.range(51).select(F.when(F.col("id") < 50, "A1C,D3E").otherwise("F5G").alias("m"))
    seqs = spark.createDataFrame([("A1C", "F5G")], "seq0 string, seq1 string")
    out = pairs.synthetic_negatives(seqs, known, 1, 20, 3)
    assert {r.seq1 for r in out.collect()} <= {"A1C,F5G", "D3E,F5G"}
    assert made(out, "Range (") == 0
