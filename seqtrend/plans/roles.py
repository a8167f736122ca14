"""The driver tables in the roles of this library's inputs, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit(i: str) -> str:
    return f"concat(chr(CAST(65 + ({i}) % 20 AS INT)), CAST(10 * ({i}) + 7 AS INT), chr(CAST(65 + (({i}) * 7 + 3) % 20 AS INT)))"


#: A variant's key: up to three substitutions by the supplier's number, runs of deletions, an insertion, a stop; none is the reference.
VARIANT = (
    f"concat_ws(',', CASE WHEN l_suppkey % 2 = 0 THEN {_unit('l_suppkey % 5')} END, "
    f"CASE WHEN l_suppkey % 3 <> 0 THEN {_unit('5 + l_suppkey % 11')} END, CASE WHEN l_suppkey % 5 <> 0 THEN {_unit('20 + l_suppkey % 17')} END, "
    "CASE WHEN l_suppkey % 4 = 1 THEN 'W374del,Y375del' END, CASE WHEN l_suppkey % 8 = 5 THEN 'A376del' END, CASE WHEN l_suppkey % 6 = 2 THEN 'ins380GA' END, "
    "CASE WHEN l_suppkey % 9 = 4 THEN 'P385del' END, CASE WHEN l_suppkey % 13 = 5 THEN 'W390stop' END)"
)

OBS = f"""obs AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS acc,
         r_name AS location, p_brand AS lineage, CAST(l_shipdate AS DATE) AS d, {VARIANT} AS m
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: The reference sequence of the variants.
REFERENCE = "ACDEFGHIKLMNPQRSTVWY" * 20 + "*"

#: Tokens of every variant, its units (runs of deletions as one), its full sequence and the spans that changed.
VARIANTS = """v AS (SELECT DISTINCT m, list_filter(string_split(m, ','), lambda t: t <> '') AS ts FROM obs),
tok AS (SELECT m, i, t, CAST(regexp_extract(t, '[0-9]+') AS INT) AS pos, regexp_extract(t, '^[A-Za-z]+') AS ref, regexp_extract(t, '[A-Za-z]+$') AS alt
  FROM (SELECT m, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM v)),
flagged AS (SELECT *, CASE WHEN alt = 'del' AND lag(alt) OVER w = 'del' AND lag(pos) OVER w + 1 = pos THEN 0 ELSE 1 END AS fresh,
  CASE WHEN ref = 'ins' THEN length(alt) WHEN alt = 'del' THEN -1 ELSE length(alt) - 1 END AS delta FROM tok WINDOW w AS (PARTITION BY m ORDER BY i)),
summed AS (SELECT *, sum(fresh) OVER w AS k, sum(delta) OVER w - delta AS s FROM flagged WINDOW w AS (PARTITION BY m ORDER BY i)),
unit AS (SELECT m, k, string_agg(t, ',' ORDER BY i) AS u FROM summed GROUP BY m, k),
units AS (SELECT v.m, coalesce(list(u ORDER BY k) FILTER (u IS NOT NULL), []) AS us FROM v LEFT JOIN unit ON v.m = unit.m GROUP BY v.m)"""

SEQUENCES = f"""put AS (SELECT m, pos, string_agg(CASE WHEN alt = 'del' THEN '' ELSE alt END, '') AS alt FROM tok WHERE ref <> 'ins' GROUP BY m, pos),
behind AS (SELECT m, pos, string_agg(alt, '' ORDER BY i) AS alt FROM tok WHERE ref = 'ins' GROUP BY m, pos),
letter AS (SELECT m, p, substr('{REFERENCE}', p, 1) AS c FROM v, (SELECT CAST(unnest(range(1, {len(REFERENCE) + 1})) AS INT) AS p)),
seqs AS (SELECT l.m, string_agg(concat(coalesce(put.alt, c), coalesce(behind.alt, '')), '' ORDER BY p) AS seq
  FROM letter l LEFT JOIN put ON put.m = l.m AND put.pos = p LEFT JOIN behind ON behind.m = l.m AND behind.pos = p GROUP BY l.m)"""

#: Observations with the week since the first date.
WEEKS = OBS + ", wobs AS (SELECT *, CAST(floor((d - (SELECT min(d) FROM obs)) / 7) AS INT) AS w FROM obs)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(acc, location, lineage, d, m): lineitem with part and its supplier's region."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    place = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = line.join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(place.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    acc = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return rows.select(acc.alias("acc"), F.col("r_name").alias("location"), F.col("p_brand").alias("lineage"), F.col("l_shipdate").cast("date").alias("d"), F.expr(VARIANT).alias("m"))


def letters(c: str) -> Column:
    """The letters of a text in upper case, and an end mark."""
    return F.concat(F.upper(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^A-Za-z]", "")), F.lit("*"))


LETTERS = "concat(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '*')"

SAMPLES = f"""raw AS (
  SELECT source AS run, doc_id, {LETTERS} AS seq, n_chars, lang,
         CAST((n_chars * 7919 + doc_id * 104729) % 10007 AS DOUBLE) / 10007 AS score,
         n_chars % 11 = 0 AS invalid_seq, n_chars % 11 <> 0 AND doc_id % 3 = 0 AS new_seq,
         n_chars % 11 <> 0 AND doc_id % 3 = 1 AS old_seq, n_chars % 11 <> 0 AND doc_id % 3 = 2 AS false_seq,
         n_chars % 40 AS count, n_chars % 7 AS novelty, [lang, concat('q', CAST(n_chars % 50 AS VARCHAR))] AS lineage, n_chars % 2 = 0 AS new_lineage
  FROM documents),
samples AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, doc_id) AS rank FROM raw)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and classified samples: documents, with flags and counts derived from their numbers."""
    from pyspark.sql import Window

    n, k = F.col("n_chars"), F.col("doc_id")
    valid = n % 11 != 0
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("run"), "doc_id", letters("text").alias("seq"), "n_chars", "lang", (((n * 7919 + k * 104729) % 10007).cast("double") / 10007).alias("score"), (~valid).alias("invalid_seq"),
        (valid & (k % 3 == 0)).alias("new_seq"), (valid & (k % 3 == 1)).alias("old_seq"), (valid & (k % 3 == 2)).alias("false_seq"), (n % 40).alias("count"), (n % 7).alias("novelty"),
        F.array("lang", F.concat(F.lit("q"), (n % 50).cast("string"))).alias("lineage"), (n % 2 == 0).alias("new_lineage"),
    )
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("score"), "doc_id")).cast("long"))


HITS = """hits AS (
  SELECT event_type AS run, CAST(event_id AS VARCHAR) AS seq, CAST(ts AS DATE) AS seq_date, value AS score, CAST(floor(value) AS BIGINT) AS count,
         TRUE AS new_seq, FALSE AS invalid_seq, [concat('u', CAST(user_id AS VARCHAR))] AS lineage, user_id % 2 = 0 AS new_lineage FROM events)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated hits: events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").cast("string").alias("seq"), F.col("ts").cast("date").alias("seq_date"), F.col("value").alias("score"), F.floor("value").cast("long").alias("count"),
        F.lit(True).alias("new_seq"), F.lit(False).alias("invalid_seq"), F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("lineage"), (F.col("user_id") % 2 == 0).alias("new_lineage"),
    )


CLUSTERS = "clusters AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, c_name AS cluster FROM orders JOIN customer ON o_custkey = c_custkey)"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster): orders by their customer."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("id"), F.col("c_name").alias("cluster"))
