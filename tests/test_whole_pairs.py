from pyspark.sql import functions as F

from seqtrend.jobs import make_pairs


def test_no_partner_and_no_pair_is_dropped(spark):
    """a variant of more partners than a default cap held (750) keeps them all, and all pairs meet both regions."""
    rows = spark.range(1100).select(F.concat(F.lit("A"), F.col("id").cast("string"), F.lit("C")).alias("m"), F.explode(F.sequence(F.lit(1), F.when(F.col("id") < 3, 12).otherwise(2))).alias("i"))
    rows = rows.select("m", F.explode(F.array(F.lit("ASIA"), F.lit("EUROPE"))).alias("location"), F.lit("2024-01-01").cast("date").alias("d"))
    made = make_pairs.run(rows, "ASIA", "~ASIA", last_week=20, blocks=(4, 1, 0), how="union", max_p_diff=1.0).where("split = 'train'").collect()
    leaders = {r.seq0 for r in made if r.count0 > r.count1}
    partners = {m: {r.seq1 for r in made if r.seq0 == m} for m in leaders}
    assert leaders and leaders <= {"A0C", "A1C", "A2C"} and all(len(p) > 870 - len(leaders) for p in partners.values()), {m: len(p) for m, p in partners.items()}
    assert all(p - {"A0C", "A1C", "A2C"} == partners[min(leaders)] - {"A0C", "A1C", "A2C"} for p in partners.values())
