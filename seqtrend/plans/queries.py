"""Registered queries over the driver tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.functions import dates, mutations, tokens
from seqtrend.functions.rand import rand_key
from seqtrend.sources import clusters as cluster_files
from seqtrend.sources import fasta, tables
from seqtrend.sources.scratch import scratch_path, stored
from seqtrend.operators import audit, evaluate, kmer_index, matching, pairs, ranks, series, splits
from seqtrend.plans.roles import CLUSTERS, HITS, LETTERS, OBS, REFERENCE, SAMPLES, SEQUENCES, VARIANTS, WEEKS, clusters, hits, letters, observations, samples, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAY = "2000-01-01"
LAST_WEEK = 400  # beyond the last date of the driver tables
RANGES = [(0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.01)]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _key(seed: int | str, *cols: str) -> str:
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
    return f"CAST(('0x' || left(sha256(concat_ws('|', '{seed}', {parts})), 15)) AS BIGINT)"


def weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.with_week(observations(spark, sf_dir))


# -- filters, first sightings, counts ----------------------------------------------------------------------


@query(f"WITH {OBS} SELECT m, count(*) AS n FROM obs WHERE (location LIKE '%ASIA%' OR location LIKE '%EUROPE%') AND d > DATE '1997-01-01' AND d <= DATE '2000-06-30' GROUP BY m")
def p1_p2_window_and_locations(spark, sf_dir):
    rows = series.date_window(observations(spark, sf_dir), "1997-01-01", "2000-06-30", closed="right")
    return series.variant_counts(rows.where(series.in_locations("ASIA,EUROPE")))


@query(f"WITH {OBS} SELECT location, count(*) AS n FROM obs WHERE NOT (location LIKE '%ASIA%' OR location LIKE '%EUROPE%') GROUP BY location")
def p2_excluded_locations(spark, sf_dir):
    return series.variant_counts(observations(spark, sf_dir).where(series.in_locations("~ASIA,EUROPE")), "location")


@query(f"WITH {OBS}, v AS (SELECT DISTINCT m FROM obs WHERE d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND m NOT LIKE '%stop%') SELECT m, {_key(3, 'm')} % 4 AS shard FROM v")
def p5_distinct_variants(spark, sf_dir):
    return series.distinct_variants(observations(spark, sf_dir), "1996-01-01", "1996-12-31", 4, seed=3)


@query(f"WITH {OBS} SELECT m, min(d) AS d, min_by(acc, (d, acc)) AS acc FROM obs GROUP BY m".replace("min_by(acc, (d, acc))", "arg_min(acc, row(d, acc))"))
def w1_first_seen(spark, sf_dir):
    return series.first_seen(observations(spark, sf_dir).select("m", "d", "acc")).select("m", "d", "acc")


@query(f"WITH {WEEKS} SELECT m, w, count(*) AS n FROM wobs GROUP BY m, w")
def a1_weekly_counts(spark, sf_dir):
    return series.weekly_counts(weeks(spark, sf_dir))


SERIES = f"""{WEEKS}, weeks AS (SELECT CAST(unnest(range(0, {LAST_WEEK + 1})) AS INT) AS w),
series AS (SELECT m, min(w) AS week, count(*) AS total FROM wobs GROUP BY m),
wn AS (SELECT m, w, count(*) AS n FROM wobs GROUP BY m, w),
cum AS (SELECT s.m, s.week, weeks.w, CAST(sum(coalesce(wn.n, 0)) OVER (PARTITION BY s.m ORDER BY weeks.w) AS DOUBLE) AS c
        FROM series s CROSS JOIN weeks LEFT JOIN wn ON wn.m = s.m AND wn.w = weeks.w)"""


@query(f"WITH {SERIES} SELECT m, week, CAST(max(c) AS BIGINT) AS total, string_agg(CAST(c AS BIGINT), ',' ORDER BY w) AS counts FROM cum GROUP BY m, week")
def a2_variant_series(spark, sf_dir):
    rows = series.variant_series(weeks(spark, sf_dir), LAST_WEEK)
    return rows.select("m", "week", F.col("total").cast("long").alias("total"), F.array_join(F.transform("counts", lambda c: c.cast("long").cast("string")), ",").alias("counts"))


@query(f"WITH {OBS} SELECT m, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM obs), 9) AS share FROM obs GROUP BY m")
def a3_prevalence(spark, sf_dir):
    return series.prevalence(observations(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(f"WITH {WEEKS}, c AS (SELECT m, count(*) AS n, max(w) AS last FROM wobs GROUP BY m) SELECT m, n, CASE WHEN n >= 500 THEN 'frequent' ELSE 'rare' END AS kind FROM c WHERE n >= 500 OR (n <= 400 AND last <= (SELECT max(w) FROM wobs) - 2)")
def a5_frequent_and_rare(spark, sf_dir):
    return series.frequent_and_rare(weeks(spark, sf_dir), trailing=2, min_count=500, max_total=400)


@query(f"WITH {WEEKS}, f AS (SELECT m, CAST(min(w) AS INT) AS w, count(*) AS n FROM (SELECT m, CAST(floor((d - (SELECT min(d) FROM obs)) / 7) AS INT) AS w FROM obs WHERE d <= DATE '1995-01-20') GROUP BY m) SELECT m, w, n FROM f WHERE w = (SELECT max(floor((d - (SELECT min(d) FROM obs)) / 7)) FROM obs WHERE d <= DATE '1995-01-20') - 3 + 2")
def a10_validation_targets(spark, sf_dir):
    return series.validation_targets(observations(spark, sf_dir), "1995-01-20", 3)


@query(f"""WITH {WEEKS}, f AS (SELECT m, min(d) AS d, min(w) AS a, max(w) AS b FROM wobs GROUP BY m),
g AS (SELECT m, d, CAST(unnest(range(a, b + 1)) AS INT) AS w FROM f WHERE d BETWEEN DATE '1995-01-01' AND DATE '1995-02-15'),
n AS (SELECT m, w, count(*) AS n FROM wobs GROUP BY m, w)
SELECT g.m, g.d, string_agg(CAST(coalesce(n.n, 0) AS VARCHAR), ',' ORDER BY g.w) AS counts FROM g LEFT JOIN n ON n.m = g.m AND n.w = g.w GROUP BY g.m, g.d""")
def a11_sequences_in_timeframe(spark, sf_dir):
    rows = series.sequences_in_timeframe(observations(spark, sf_dir), "1995-01-01", "1995-02-15")
    return rows.select("m", "d", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


# -- text and sequence functions ---------------------------------------------------------------------------


@query(f"WITH {OBS} SELECT m, count(*) AS n FROM obs GROUP BY m")
def f1_extract_mutations(spark, sf_dir):
    named = F.concat(F.lit("(NSP3_A5T,"), F.array_join(F.transform(F.reverse(mutations.tokens("m")), lambda t: F.concat(F.lit("Spike_"), t)), ","), F.lit(",N_A3-)"))
    return series.variant_counts(observations(spark, sf_dir).select(mutations.extract_mutations(named).alias("m")))


@query("SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_orderdate AS DATE) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(floor((CAST(o_orderdate AS DATE) - DATE '1995-01-01') / 7.0) AS INT) AS w, CAST(ceil((CAST(o_orderdate AS DATE) - DATE '1995-01-01') / 28.0) AS INT) AS period FROM orders")
def f3_f4_f5_dates(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    start = F.lit("1995-01-01").cast("date")
    parsed = dates.parse_date(d.cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), parsed.alias("d"), dates.parse_date(F.date_format(d, "yyyy-MM")).alias("first"), dates.week_index(parsed, start).alias("w"), dates.week_after(parsed, start, 28).alias("period"))


@query(f"WITH {OBS}, {VARIANTS} SELECT m, CAST(len(us) AS INT) AS n_units, array_to_string(us, '|') AS units FROM units")
def f8_mutation_units(spark, sf_dir):
    rows = observations(spark, sf_dir).select("m").distinct().select("m", mutations.mutation_units("m").alias("us"))
    return rows.select("m", F.size("us").alias("n_units"), F.array_join("us", "|").alias("units"))


@query(f"WITH s AS (SELECT doc_id, {LETTERS} AS seq FROM documents) SELECT doc_id, array_to_string(list_prepend(26, list_transform(string_split(seq, ''), lambda c: CASE WHEN c = '*' THEN 27 ELSE CAST(instr('{tokens.LETTERS}', c) AS INT) - 1 END)), ',') AS ids FROM s")
def f14_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", letters("text").alias("seq"))
    return rows.select("doc_id", F.array_join(F.transform(tokens.encode("seq"), lambda i: i.cast("string")), ",").alias("ids"))


@query(f"WITH s AS (SELECT doc_id, rtrim({LETTERS}, '*') AS seq FROM documents), p AS (SELECT doc_id, seq, unnest(range(0, CAST(ceil(length(seq) / 512.0) AS BIGINT))) AS i FROM s) SELECT doc_id, CAST(i AS INT) AS fragment, substr(seq, i * 512 + 1, 512) AS piece FROM p")
def f16_chunk_sequence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", letters("text").alias("seq"))
    return tokens.chunk_sequence(rows, 512).select("doc_id", "fragment", "piece")


@query(f"""WITH s AS (SELECT doc_id, {LETTERS} AS seq FROM documents), l AS (SELECT doc_id, seq, unnest(range(1, 22)) AS n FROM s),
u AS (SELECT doc_id, n FROM l WHERE n <= length(seq) AND instr(substr(seq, 2), substr(seq, 1, n)) = 0)
SELECT s.doc_id, CAST(min(u.n) AS INT) AS prefix FROM s LEFT JOIN u ON s.doc_id = u.doc_id GROUP BY s.doc_id""")
def f17_anchor_length(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", letters("text").alias("seq"))
    return rows.select("doc_id", tokens.anchor_length("seq").alias("prefix"))


ANCHORS = f"""s AS (SELECT doc_id, {LETTERS} AS seq, reverse({LETTERS}) AS rev FROM documents), l AS (SELECT doc_id, seq, rev, unnest(range(1, 22)) AS n FROM s),
pre AS (SELECT doc_id, min(n) AS a FROM l WHERE n <= length(seq) AND instr(substr(seq, 2), substr(seq, 1, n)) = 0 GROUP BY doc_id),
suf AS (SELECT doc_id, min(n) AS b FROM l WHERE n <= length(seq) AND instr(substr(rev, 2), substr(rev, 1, n)) = 0 GROUP BY doc_id)"""


@query(f"WITH {ANCHORS} SELECT s.doc_id, CAST(b AS INT) AS suffix FROM s LEFT JOIN suf USING (doc_id)")
def f17_suffix_length(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", letters("text").alias("seq"))
    return rows.select("doc_id", tokens.anchor_length("seq", suffix=True).alias("suffix"))


@query(f"""WITH s AS (SELECT doc_id, {LETTERS} AS seq FROM documents), w AS (SELECT doc_id, seq, unnest(range(0, length(seq), 300)) AS a FROM s),
c AS (SELECT doc_id, a, least(a + 500, length(seq) - 1) AS b FROM w), k AS (SELECT * FROM c WHERE b > a),
f AS (SELECT doc_id, a, b, unnest(list_concat([a - 1], list_filter([40, 700], lambda x: x >= a AND x < b))) AS lo FROM k),
g AS (SELECT doc_id, lo + 1 AS mask_start, least(b, CASE WHEN lo < 40 AND 40 >= a AND 40 < b THEN 40 WHEN lo < 700 AND 700 >= a AND 700 < b THEN 700 ELSE b END) AS hi FROM f)
SELECT doc_id, CAST(mask_start AS INT) AS mask_start, CAST(hi - mask_start AS INT) AS mask_length FROM g WHERE hi > mask_start""")
def f21_sliding_stimuli(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", letters("text").alias("seq"))
    return tokens.sliding_stimuli(rows, 500, 300, [40, 700]).select("doc_id", "mask_start", "mask_length")


@query(f"WITH s AS (SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN '[X]' WHEN doc_id % 7 = 0 THEN '*' WHEN doc_id % 11 = 0 THEN '<' ELSE '' END, CASE WHEN doc_id % 13 = 0 THEN rtrim({LETTERS}, '*') ELSE {LETTERS} END) AS seq FROM documents) SELECT doc_id, CAST(length(seq) AS INT) AS n, doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND (doc_id % 7 = 0) = (doc_id % 13 = 0) OR (doc_id % 5 <> 0 AND doc_id % 7 = 0 AND doc_id % 13 = 0) AS valid FROM s")
def f9_valid_samples(spark, sf_dir):
    k = F.col("doc_id")
    mark = F.when(k % 5 == 0, "[X]").when(k % 7 == 0, "*").when(k % 11 == 0, "<").otherwise("")
    seq = F.concat(mark, F.when(k % 13 == 0, F.rtrim(letters("text"), F.lit("*"))).otherwise(letters("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", seq.alias("seq"))
    return rows.select("doc_id", F.length("seq").alias("n"), mutations.is_valid_sample("seq").alias("valid"))


@query(f"""WITH {ANCHORS}, x AS (SELECT doc_id, seq, a, b, least(length(seq) // 2, 50, length(seq) - 2, length(seq) - a - b) AS most FROM s JOIN pre USING (doc_id) JOIN suf USING (doc_id)),
y AS (SELECT *, 1 + {_key(5, 'seq')} % most AS k FROM x WHERE most >= 1), z AS (SELECT *, length(seq) - k - a - b + 1 AS room FROM y),
g AS (SELECT *, a + {_key(6, 'seq')} % room AS start FROM z WHERE room > 0)
SELECT doc_id, CAST(start AS INT) AS mask_start, CAST(k AS INT) AS mask_length, md5(concat('[CLS]', substr(seq, 1, start), '[MASK]', substr(seq, start + k + 1), '[SEP]')) AS encoder, concat(substr(seq, start + 1, k), '[MASK]') AS decoder FROM g""")
def f18_masked_example(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", letters("text").alias("seq"))
    text = lambda c: F.array_join(f"example.{c}", "")
    return tokens.masked_example(rows, seed=5).select("doc_id", "mask_start", "mask_length", F.md5(text("encoder").cast("binary")).alias("encoder"), text("decoder").alias("decoder"))


def _tiles_sql(rows: str, id_: str, seed: int, shortest: int, longest: int) -> str:
    """Recursive CTE t (id, h, i, a, k): tile i of every sequence (id, seq) of ``rows``, and its key h."""
    return f"""t AS (SELECT {id_}, length(seq) AS n, {_key(seed, "seq")} AS h, 0 AS i, 0 AS next, -1 AS k, -1 AS a FROM {rows} UNION ALL
  SELECT {id_}, n, h, i + 1, next + len, len, next FROM (SELECT *, CAST(low + draw % ({longest} - low + 1) AS INT) AS len FROM (
    SELECT *, CASE WHEN k = 0 THEN {max(shortest, 1)} ELSE {shortest} END AS low, {_key(seed, "h", "i + 1")} AS draw FROM t WHERE next < n)))"""


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, {LETTERS} AS seq FROM documents), {_tiles_sql("s", "doc_id", 5, 0, 128)}
SELECT doc_id, a AS mask_start, k AS mask_length FROM t WHERE i > 0""")
def f19_tile_masks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", letters("text").alias("seq"))
    return tokens.tile_masks(rows, seed=5).select("doc_id", "mask_start", "mask_length")


@query(f"""WITH {OBS}, {VARIANTS}, {SEQUENCES}, sp AS (SELECT m, i, CASE WHEN ref = 'ins' THEN greatest(0, pos + s - 1) WHEN alt = 'del' THEN greatest(0, pos + s - 2) ELSE greatest(0, pos + s - 1) END AS a,
CASE WHEN ref = 'ins' THEN pos + s + length(alt) + 1 WHEN alt = 'del' THEN pos + s ELSE pos + s - 1 + length(alt) END AS b FROM summed WHERE fresh = 1)
SELECT seqs.m, any_value(seq) AS seq, coalesce(string_agg(concat(CAST(a AS BIGINT), '-', CAST(b AS BIGINT)), ',' ORDER BY i) FILTER (a IS NOT NULL), '') AS spans FROM seqs LEFT JOIN sp ON sp.m = seqs.m GROUP BY seqs.m""")
def f6_f7_apply_mutations(spark, sf_dir):
    seqs = mutations.apply_mutations(observations(spark, sf_dir).select("m").distinct(), REFERENCE)
    text = F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return mutations.changed_spans(seqs).select("m", "seq", F.array_join(text, ",").alias("spans"))


# -- pairs -------------------------------------------------------------------------------------------------

_BRACKET = "(CASE " + " ".join(f"WHEN {{x}} >= {a}::DOUBLE AND {{x}} < {b}::DOUBLE THEN {t}" for a, b, t in pairs.BRACKETS) + " END)"
PAIRS = f"""{SERIES}, tot AS (SELECT s.m, s.week, CAST(s.total AS DOUBLE) AS total FROM series s),
cand AS (SELECT a.m AS seq0, b.m AS seq1, a.week AS w0, b.week AS w1, least({LAST_WEEK} - a.week + 1, {LAST_WEEK} - b.week + 1) AS period
  FROM tot a JOIN tot b ON abs(a.week - b.week) <= {_BRACKET.format(x="1 / a.total")} WHERE a.total >= {pairs.MIN_TOTAL}),
cc AS (SELECT cand.*, x.c AS count0, y.c AS count1 FROM cand JOIN cum x ON x.m = seq0 AND x.w = w0 + period - 1 JOIN cum y ON y.m = seq1 AND y.w = w1 + period - 1),
pairs AS (SELECT seq0, count0, seq1, count1, CAST(period AS INT) AS period FROM cc WHERE count1 <= count0 AND abs(w1 - w0) <= {_BRACKET.format(x="count1 / count0")}
  AND {LAST_WEEK} - w0 + 1 >= greatest(2 * abs(w1 - w0), {pairs.MIN_LEAD}) AND {LAST_WEEK} - w1 + 1 >= greatest(2 * abs(w1 - w0), {pairs.MIN_LEAD}))"""


def _pairs(spark, sf_dir, **more) -> DataFrame:
    return pairs.week_band_pairs(stored(series.variant_series(weeks(spark, sf_dir), LAST_WEEK), "series"), LAST_WEEK, **more)


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def j2_week_band_pairs(spark, sf_dir):
    """The flagship."""
    return _pairs(spark, sf_dir)


_COUNTED = f"""cc AS (SELECT cand.*, x.c AS count0, y.c AS count1 FROM cand JOIN cum x ON x.m = seq0 AND x.w = w0 + period - 1 JOIN cum y ON y.m = seq1 AND y.w = w1 + period - 1),
pairs AS (SELECT seq0, count0, seq1, count1, CAST(period AS INT) AS period FROM cc WHERE count1 <= count0 AND abs(w1 - w0) <= {_BRACKET.format(x="count1 / count0")}
  AND {LAST_WEEK} - w0 + 1 >= greatest(2 * abs(w1 - w0), {pairs.MIN_LEAD}) AND {LAST_WEEK} - w1 + 1 >= greatest(2 * abs(w1 - w0), {pairs.MIN_LEAD}))"""


@query(f"""WITH {SERIES}, tot AS (SELECT m, week, CAST(total AS DOUBLE) AS total FROM series),
near AS (SELECT a.m AS seq0, b.m AS seq1, a.week AS w0, b.week AS w1, least({LAST_WEEK} - a.week + 1, {LAST_WEEK} - b.week + 1) AS period, row_number() OVER (PARTITION BY a.m ORDER BY {_key(1, 'b.m')}, b.m) AS rn
  FROM tot a JOIN tot b ON abs(a.week - b.week) <= {_BRACKET.format(x="1 / a.total")} WHERE a.total >= {pairs.MIN_TOTAL} AND {LAST_WEEK} - a.week + 1 >= {pairs.MIN_LEAD}),
cand AS (SELECT * FROM near WHERE rn <= 20), {_COUNTED} SELECT * FROM pairs""")
def w11_capped_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, cap=20, seed=1)


def _regions(spark, sf_dir):
    rows = weeks(spark, sf_dir)
    return [series.variant_series(rows.where(series.in_locations(x)), LAST_WEEK) for x in ("ASIA,EUROPE", "~ASIA,EUROPE")]


@query(f"""WITH {WEEKS}, a AS (SELECT m, min(w) AS week, count(*) AS n FROM wobs WHERE location IN ('ASIA', 'EUROPE') GROUP BY m), b AS (SELECT m, min(w) AS week, count(*) AS n FROM wobs WHERE location NOT IN ('ASIA', 'EUROPE') GROUP BY m)
SELECT coalesce(a.m, b.m) AS m, least(a.week, b.week) AS week, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS DOUBLE) AS total FROM a FULL JOIN b ON a.m = b.m""")
def j3_combined_regions(spark, sf_dir):
    return pairs.combine_regions(*_regions(spark, sf_dir), how="union").select("m", "week", "total")


def _side_sql(x: str, where: str) -> str:
    return f"""{x}n AS (SELECT m, w, count(*) AS n FROM wobs WHERE {where} GROUP BY m, w), {x}s AS (SELECT m, min(w) AS week FROM {x}n GROUP BY m),
{x}c AS (SELECT s.m, s.week, weeks.w, CAST(sum(coalesce(n.n, 0)) OVER (PARTITION BY s.m ORDER BY weeks.w) AS BIGINT) AS c FROM {x}s s CROSS JOIN weeks LEFT JOIN {x}n n ON n.m = s.m AND n.w = weeks.w)"""


def _at_sql(x: str) -> str:
    period = f"least({LAST_WEEK} + 1 - {x}0.week, {LAST_WEEK} + 1 - {x}1.week)"
    return " ".join(f"JOIN {x}s {x}{i} ON {x}{i}.m = seq{i}" for i in (0, 1)) + " " + " ".join(f"JOIN {x}c {x}c{i} ON {x}c{i}.m = seq{i} AND {x}c{i}.w = {x}{i}.week + {period} - 1" for i in (0, 1))


#: Two regions: even and odd orders. The pairs of the variants that both have, with their counts in either.
AGREED = f"""{PAIRS}, {_side_sql('ra', "CAST(split_part(acc, '-', 1) AS BIGINT) % 2 = 0")}, {_side_sql('rb', "CAST(split_part(acc, '-', 1) AS BIGINT) % 2 = 1")},
sided AS (SELECT pairs.*, rac0.c AS a0, rac1.c AS a1, rbc0.c AS b0, rbc1.c AS b1 FROM pairs {_at_sql('ra')} {_at_sql('rb')}),
fs AS (SELECT *, [count1 / (count0 + count1 + 1e-12), a1 / (a0 + a1 + 1e-12), b1 / (b0 + b1 + 1e-12)] AS f FROM sided),
low AS (SELECT *, list_max(f) - list_min(f) AS diff FROM fs WHERE list_max(f) <= 0.5)"""
FISHER = """tb AS (SELECT DISTINCT a0, a1, b0, b1 FROM low), tx AS (SELECT *, unnest(range(greatest(0, (a0 + b0) - (b0 + b1)), least(a0 + a1, a0 + b0) + 1)) AS x FROM tb),
lf AS (SELECT *, lgamma(a0 + a1 + 1) + lgamma(b0 + b1 + 1) + lgamma(a0 + b0 + 1) + lgamma(a1 + b1 + 1) - lgamma(a0 + a1 + b0 + b1 + 1) - lgamma(x + 1) - lgamma(a0 + a1 - x + 1) - lgamma(a0 + b0 - x + 1) - lgamma(b1 - a0 + x + 1) AS lp FROM tx),
pv AS (SELECT f.a0, f.a1, f.b0, f.b1, CASE WHEN min(least(f.a0 + f.a1, f.b0 + f.b1, f.a0 + f.b0, f.a1 + f.b1)) = 0 THEN 1 ELSE sum(exp(f.lp)) FILTER (f.lp <= h.lp + 1e-7) END AS p
  FROM lf f JOIN lf h ON f.a0 = h.a0 AND f.a1 = h.a1 AND f.b0 = h.b0 AND f.b1 = h.b1 AND h.x = h.a0 GROUP BY f.a0, f.a1, f.b0, f.b1)"""
AGREED_BY = "SELECT seq0, count0, seq1, count1, period FROM low JOIN pv USING (a0, a1, b0, b1) WHERE count1 / (count0 + count1) < 0.01 OR {test}"


def _agreed(spark, sf_dir, **how) -> DataFrame:
    rows = weeks(spark, sf_dir).withColumn("_odd", F.substring_index("acc", "-", 1).cast("long") % 2)
    a, b = (stored(series.variant_series(rows.where(F.col("_odd") == i), LAST_WEEK), "series") for i in (0, 1))
    return pairs.validate_pairs(pairs.week_band_pairs(pairs.combine_regions(a, b), LAST_WEEK), a, b, **how)


@query(f"WITH {AGREED}, {FISHER} {AGREED_BY.format(test='p >= 0.1')}")
def a18_validated_pairs(spark, sf_dir):
    return _agreed(spark, sf_dir, p_value=0.1)


@query(f"WITH {AGREED} SELECT seq0, count0, seq1, count1, period FROM low WHERE diff <= 0.02")
def a18_by_difference(spark, sf_dir):
    return _agreed(spark, sf_dir, max_p_diff=0.02)


@query(f"""WITH {AGREED}, {FISHER}, q AS (SELECT *, a0 + a1 + b0 + b1 AS n, (a0 + a1) * (a0 + b0) / (a0 + a1 + b0 + b1) AS e, least((a0 + a1) * (a0 + b0), (a0 + a1) * (a1 + b1), (b0 + b1) * (a0 + b0), (b0 + b1) * (a1 + b1)) / (a0 + a1 + b0 + b1) AS least_e FROM low JOIN pv USING (a0, a1, b0, b1)),
chi AS (SELECT *, CASE WHEN least(a0, a1, b0, b1) >= 5 AND least_e >= 5 THEN power(abs(a0 - e) - least(0.5, abs(a0 - e)), 2) * (n / (a0 + a1) / (a0 + b0) + n / (a0 + a1) / (a1 + b1) + n / (b0 + b1) / (a0 + b0) + n / (b0 + b1) / (a1 + b1)) END AS x2 FROM q)
SELECT seq0, count0, seq1, count1, period FROM chi WHERE count1 / (count0 + count1) < 0.01 OR CASE WHEN x2 IS NULL THEN p >= 0.1 ELSE x2 <= 2.7055434540954 END""")
def a18_by_chi_square(spark, sf_dir):
    return _agreed(spark, sf_dir, p_value=0.1, use_chi2=True)


@query(f"WITH {PAIRS}, p AS (SELECT count1 / (count0 + count1) AS p FROM pairs) SELECT round(avg(-p * ln(p) - (1 - p) * ln(1 - p)), 8) AS min_loss FROM p")
def a14_min_loss(spark, sf_dir):
    return pairs.min_loss(_pairs(spark, sf_dir)).select(F.round("min_loss", 8).alias("min_loss"))


@query(f"""WITH {WEEKS}, f AS (SELECT m, min(w) AS w, count(*) AS n FROM wobs GROUP BY m), k AS (SELECT w, count(*) AS k FROM f GROUP BY w),
r AS (SELECT f.*, row_number() OVER (PARTITION BY w ORDER BY {_key('2-week', 'm')}, m) - 1 AS rn FROM f), j AS (SELECT w, k, unnest(range(0, k)) AS j FROM k WHERE k > 1),
q AS (SELECT w, k, j * (k * (k - 1)) // k + {_key(2, 'w', 'j')} % ((j + 1) * (k * (k - 1)) // k - j * (k * (k - 1)) // k) AS q FROM j),
ab AS (SELECT w, q // (k - 1) AS a, q % (k - 1) + CASE WHEN q % (k - 1) >= q // (k - 1) THEN 1 ELSE 0 END AS b FROM q)
SELECT x.m AS seq0, y.m AS seq1, ab.w, round(CAST(y.n AS DOUBLE) / (x.n + y.n), 9) AS label FROM ab JOIN r x ON x.w = ab.w AND x.rn = a JOIN r y ON y.w = ab.w AND y.rn = b""")
def j5_same_week_pairs(spark, sf_dir):
    return pairs.same_week_pairs(weeks(spark, sf_dir), seed=2).withColumn("label", F.round("label", 9))


_PLACES = "(CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END)"


def _draw_sql(j: str, n: str, size: str, key: str) -> str:
    return f"({j} * {size}) // {n} + {key} % ((({j} + 1) * {size}) // {n} - ({j} * {size}) // {n})"


def _split_pairs_sql(seed: int, totals: str) -> str:
    """CTEs sp (m, split): blocks of 6 ranks by the totals (m, total), dealt 4, 1 and 1."""
    return f"""rk AS (SELECT m, total, (row_number() OVER (ORDER BY total DESC, {_key(f"{seed}-ties", "m")}, m) - 1) // 6 AS block FROM {totals}),
sl AS (SELECT m, row_number() OVER (PARTITION BY block ORDER BY {_key(seed, "m")}, m) AS pos FROM rk), sp AS (SELECT m, CASE WHEN pos <= 4 THEN 'train' WHEN pos <= 5 THEN 'val' ELSE 'test' END AS split FROM sl)"""


def _frequent_rare_sql(seed: int, known: str, most: int, min_count: int, max_total: int) -> str:
    """CTE fr: the known pairs with a split, and every frequent variant with up to ``most`` rare ones of its split; cn has (m, total)."""
    return f"""held AS (SELECT m, min(p) AS p FROM (SELECT seq0 AS m, {_PLACES} AS p FROM {known} UNION ALL SELECT seq1, {_PLACES} FROM {known}) GROUP BY m),
ls AS (SELECT m, total AS n, CASE WHEN total >= {min_count} THEN 'frequent' ELSE 'rare' END AS kind FROM cn WHERE total >= {min_count} OR total <= {max_total}),
nw AS (SELECT ls.*, row_number() OVER (PARTITION BY kind ORDER BY {_key(seed, "m")}, m) AS rn, count(*) OVER (PARTITION BY kind) AS k FROM ls WHERE m NOT IN (SELECT m FROM held)),
pl AS (SELECT ls.m, n, kind, p FROM ls JOIN held USING (m) UNION ALL SELECT m, n, kind, CASE WHEN rn <= greatest(k * 4 // 6, 1) THEN 0 WHEN rn <= greatest(k * 4 // 6, 1) + greatest(k // 6, 1) THEN 1 ELSE 2 END FROM nw),
rr AS (SELECT m, n, p, row_number() OVER (PARTITION BY p ORDER BY {_key(f"{seed}-rare", "m")}, m) - 1 AS pos, count(*) OVER (PARTITION BY p) AS size FROM pl WHERE kind = 'rare'),
fq AS (SELECT pl.m, pl.n, pl.p, size, unnest(range(0, least({most}, size))) AS j FROM pl JOIN (SELECT DISTINCT p, size FROM rr) z ON z.p = pl.p WHERE kind = 'frequent'),
dr AS (SELECT m, n, p, {_draw_sql("j", f"least({most}, size)", "size", _key(seed, "m", "j"))} AS pos FROM fq),
md AS (SELECT dr.m AS seq0, CAST(dr.n AS DOUBLE) AS count0, rr.m AS seq1, CAST(rr.n AS DOUBLE) AS count1, CAST(NULL AS INT) AS period, ['train', 'val', 'test'][dr.p + 1] AS split FROM dr JOIN rr ON rr.p = dr.p AND rr.pos = dr.pos),
fr AS (SELECT * FROM md UNION ALL SELECT seq0, count0, seq1, count1, period, split FROM {known} WHERE (split, seq0, seq1) NOT IN (SELECT (split, seq0, seq1) FROM md))"""


@query(f"""WITH {PAIRS}, cn AS (SELECT m, count(*) AS total FROM obs GROUP BY m), {_split_pairs_sql(3, "cn")},
kn AS (SELECT pairs.*, a.split FROM pairs JOIN sp a ON a.m = seq0 JOIN sp b ON b.m = seq1 WHERE a.split = b.split), {_frequent_rare_sql(3, "kn", 5000, 600, 599)} SELECT * FROM fr""")
def j4_frequent_rare_pairs(spark, sf_dir):
    lists = series.frequent_and_rare(weeks(spark, sf_dir), trailing=0, min_count=600, max_total=599)
    made = ranks.split_by_rank_blocks(series.variant_counts(observations(spark, sf_dir)).withColumnRenamed("n", "total"), 4, 1, 1, seed=3)
    known = _pairs(spark, sf_dir).join(made.select(F.col("m").alias("seq0"), "split"), "seq0").join(made.select(F.col("m").alias("seq1"), F.col("split").alias("_s")), "seq1").where("split = _s").drop("_s")
    return pairs.frequent_rare_pairs(lists, known, 4, 1, 1, seed=3)


def _negatives_sql(seed: int, known: str, n: int, trials: int) -> str:
    """CTE fake: variants of the known pairs (with a split) with n random mutations added, per split."""
    return f"""sq AS (SELECT DISTINCT split, m FROM (SELECT split, seq0 AS m FROM {known} UNION ALL SELECT split, seq1 FROM {known})),
pool AS (SELECT t, pos, row_number() OVER (ORDER BY {_key(f"{seed}-pool", "t")}, t) AS rn, count(*) OVER () AS size FROM (SELECT DISTINCT t, pos FROM tok)),
dj AS (SELECT m, trial, unnest(range(0, {2 * n + 2})) AS j FROM (SELECT m, unnest(range(1, {trials + 1})) AS trial FROM (SELECT DISTINCT m FROM sq))),
dk AS (SELECT m, trial, j, {_key(seed, "m", "trial", "j")} % (SELECT max(size) FROM pool) + 1 AS rn FROM dj),
df AS (SELECT m, trial, rn, row_number() OVER (PARTITION BY m, trial ORDER BY min(j)) AS k FROM dk GROUP BY m, trial, rn),
ad AS (SELECT df.m, trial, pool.t, pool.pos, row_number() OVER (PARTITION BY df.m, trial ORDER BY pool.pos, pool.t) AS i FROM df JOIN pool USING (rn) WHERE k <= {n}),
ok AS (SELECT m, trial FROM ad GROUP BY m, trial HAVING count(*) = {n}), bad AS (SELECT DISTINCT ad.m, trial FROM ad JOIN tok ON tok.m = ad.m AND tok.pos = ad.pos),
al AS (SELECT m, trial, t, pos, 1 AS src, i FROM ad UNION ALL SELECT ok.m, trial, t, pos, 0, i FROM ok JOIN tok USING (m)),
mk AS (SELECT al.m AS seq0, al.trial, string_agg(t, ',' ORDER BY pos, src, i) AS seq1 FROM al JOIN ok ON ok.m = al.m AND ok.trial = al.trial WHERE (al.m, al.trial) NOT IN (SELECT (m, trial) FROM bad) GROUP BY al.m, al.trial),
fake AS (SELECT seq0, CAST(1 AS DOUBLE) AS count0, seq1, CAST(0 AS DOUBLE) AS count1, CAST(NULL AS INT) AS period, split FROM mk JOIN sq ON sq.m = seq0 WHERE seq1 NOT IN (SELECT m FROM v))"""


@query(f"WITH {PAIRS}, {VARIANTS}, one AS (SELECT *, 'x' AS split FROM pairs), {_negatives_sql(4, 'one', 2, 3)} SELECT * EXCLUDE (split) FROM fake")
def j15_synthetic_negatives(spark, sf_dir):
    return pairs.synthetic_negatives(_pairs(spark, sf_dir), observations(spark, sf_dir), n_mutations=2, trials=3, seed=4)


# -- ranks and splits --------------------------------------------------------------------------------------

COUNTS = f"{OBS}, c AS (SELECT m, count(*) AS total FROM obs GROUP BY m)"


def _split_sql(at: str, a: int, b: int) -> str:
    return f"CASE WHEN {at} <= {a} THEN 'train' WHEN {at} <= {a + b} THEN 'val' ELSE 'test' END"


@query(f"""WITH {COUNTS}, r AS (SELECT m, total, (row_number() OVER (ORDER BY total DESC, {_key('7-ties', 'm')}, m) - 1) // 6 AS block FROM c),
s AS (SELECT m, total, row_number() OVER (PARTITION BY block ORDER BY {_key(7, 'm')}, m) AS pos FROM r) SELECT m, total, {_split_sql('pos', 4, 1)} AS split FROM s""")
def w2_split_by_rank_blocks(spark, sf_dir):
    return ranks.split_by_rank_blocks(series.variant_counts(observations(spark, sf_dir)).withColumnRenamed("n", "total"), 4, 1, 1, seed=7)


@query(f"""WITH {COUNTS}, r AS (SELECT m, total, (row_number() OVER (ORDER BY total DESC, {_key('7-ties', 'm')}, m) - 1) // 7 AS block FROM c),
s AS (SELECT m, total, row_number() OVER (PARTITION BY block ORDER BY {_key(7, 'm')}, m) AS pos, count(*) OVER (PARTITION BY block) AS size FROM r) SELECT m, total, CASE WHEN pos > size - 2 THEN 'val' ELSE 'train' END AS split FROM s""")
def w2_split_without_test(spark, sf_dir):
    return ranks.split_by_rank_blocks(series.variant_counts(observations(spark, sf_dir)).withColumnRenamed("n", "total"), 5, 2, 0, seed=7)


@query(f"""WITH {OBS}, c AS (SELECT lineage, count(*) AS total FROM obs GROUP BY lineage), r AS (SELECT lineage, (row_number() OVER (ORDER BY total DESC, lineage DESC) - 1) // 10 AS block FROM c),
s AS (SELECT lineage, row_number() OVER (PARTITION BY block ORDER BY {_key(0, 'lineage')}, lineage) AS pos FROM r), p AS (SELECT lineage, {_split_sql('pos', 1, 8)} AS split FROM s),
v AS (SELECT m, lineage, count(*) AS n, max(d) AS last FROM obs GROUP BY m, lineage), j AS (SELECT v.*, p.split FROM v JOIN p USING (lineage))
SELECT m, lineage, n, split FROM j WHERE (split = 'train' OR m NOT IN (SELECT m FROM j WHERE split = 'train')) AND last >= DATE '2001-06-01'""")
def w3_split_by_lineage(spark, sf_dir):
    return splits.split_by_lineage(observations(spark, sf_dir), 1, 8, 1, first_date="2001-06-01")


@query(f"WITH {OBS}, c AS (SELECT m, lineage, count(*) AS n FROM obs GROUP BY m, lineage) SELECT m, lineage, n, CAST(unnest(range(0, n)) AS INT) AS number FROM c")
def w3_enumerated(spark, sf_dir):
    rows = observations(spark, sf_dir).groupBy("m", "lineage").agg(F.count("*").alias("n"))
    return splits.enumerate_rows(rows)


@query(f"""WITH {OBS}, t AS (SELECT DISTINCT m, lineage FROM obs WHERE d <= DATE '1995-01-25'), v AS (SELECT DISTINCT m, lineage FROM obs WHERE d > DATE '1995-01-25' AND d <= DATE '1995-06-30' AND m NOT IN (SELECT m FROM t))
SELECT *, 'train' AS split FROM t UNION ALL SELECT *, 'val' AS split FROM v""")
def e1_date_split(spark, sf_dir):
    return splits.date_split(observations(spark, sf_dir), "1995-01-25", "1995-06-30")


@query(f"""WITH {OBS}, l AS (SELECT DISTINCT lineage FROM obs), r AS (SELECT lineage, row_number() OVER (ORDER BY {_key(5, 'lineage')}, lineage) AS rn FROM l)
SELECT DISTINCT obs.m, obs.lineage, CASE WHEN rn <= greatest(1, ceil(round((SELECT count(*) FROM l) * (1 - 0.9), 9))) THEN 'val' ELSE 'train' END AS split FROM obs JOIN r USING (lineage)""")
def e2_lineage_split(spark, sf_dir):
    return splits.lineage_split(observations(spark, sf_dir), 0.9, seed=5)


@query(f"""WITH {COUNTS}, q AS (SELECT *, CASE WHEN total % 3 = 0 THEN 'train' WHEN total % 5 = 0 THEN 'val' WHEN total % 2 = 0 THEN 'test' END AS split FROM c) SELECT * FROM q WHERE split IS NOT NULL""")
def e3_precomputed_split(spark, sf_dir):
    rows = series.variant_counts(observations(spark, sf_dir)).withColumnRenamed("n", "total")
    return ranks.apply_precomputed_split(rows, *[rows.where(f"total % {k} = 0").select("m") for k in (3, 5, 2)])


@query(f"""WITH {CLUSTERS}, h AS (SELECT id, cluster, CAST(('0x' || right(sha256(cluster), 8)) AS BIGINT) % 10000 AS b FROM clusters)
SELECT id, cluster, CASE WHEN b < 9800 THEN 'train' WHEN b < 9900 THEN 'val' ELSE 'test' END AS split FROM h""")
def e4_hash_cluster_split(spark, sf_dir):
    rows = clusters(spark, sf_dir)
    return splits.hash_cluster_split(rows, rows, [0.98, 0.01, 0.01], ["train", "val", "test"])


@query(f"""WITH {CLUSTERS}, n AS (SELECT DISTINCT cluster AS name FROM clusters), r AS (SELECT name, row_number() OVER (ORDER BY {_key(6, 'name')}, name) AS rn, count(*) OVER () AS k FROM n)
SELECT id, cluster AS name, CASE WHEN rn <= ceil(k * 0.8) THEN 'train' WHEN rn <= ceil(k * 0.8) + floor(k * 0.1) THEN 'val' ELSE 'test' END AS split FROM clusters JOIN r ON cluster = name""")
def e5_random_cluster_split(spark, sf_dir):
    return splits.random_cluster_split(clusters(spark, sf_dir).withColumnRenamed("cluster", "name"), 0.8, 0.1, seed=6)


@query(f"WITH {CLUSTERS}, k AS (SELECT id, CAST({_key(8, 'id')} AS DOUBLE) / {float(1 << 60)!r}::DOUBLE AS x FROM clusters) SELECT id, CASE WHEN x < 0.7 THEN 'train' WHEN x < 0.7::DOUBLE + 0.2::DOUBLE THEN 'val' ELSE 'test' END AS split FROM k")
def e6_random_record_split(spark, sf_dir):
    return splits.random_record_split(clusters(spark, sf_dir).select("id"), [0.7, 0.2, 0.1], ["train", "val", "test"], ["id"], seed=8)


@query(f"WITH {CLUSTERS} SELECT id, o_orderpriority AS split FROM clusters JOIN orders ON id = CAST(o_orderkey AS VARCHAR) WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'")
def e7_explicit_split(spark, sf_dir):
    marks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("split"))
    return splits.explicit_split(clusters(spark, sf_dir).select("id"), marks.where(F.substring("split", 1, 1).isin("1", "2")))


@query(f"WITH {OBS} SELECT m, CASE WHEN min(d) <= DATE '1995-01-15' THEN 'old' ELSE 'new' END AS age FROM obs GROUP BY m")
def e8_new_vs_old(spark, sf_dir):
    return splits.new_vs_old(observations(spark, sf_dir), "1995-01-15")


@query("SELECT DISTINCT doc_id, [CAST(n_chars AS INT) % 50] IN (SELECT [CAST(length(text) AS INT) % 50] FROM benchmark) AS known FROM documents")
def e9_membership(spark, sf_dir):
    prior = table(spark, sf_dir, "benchmark").select(F.array(F.length("text") % 50).alias("input_ids"))
    return matching.membership(prior, table(spark, sf_dir, "documents").select("doc_id", F.array(F.col("n_chars").cast("int") % 50).alias("input_ids"))).select("doc_id", "known")


@query("WITH a AS (SELECT l_orderkey AS seq0, l_suppkey AS seq1, sum(l_quantity) AS count0 FROM lineitem GROUP BY 1, 2), b AS (SELECT o_orderkey AS seq0, o_custkey AS seq1, o_totalprice AS count0 FROM orders) SELECT * FROM b UNION ALL SELECT * FROM a WHERE (seq0, seq1) NOT IN (SELECT (seq0, seq1) FROM b)")
def e10_pair_upsert(spark, sf_dir):
    base = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq0"), F.col("l_suppkey").alias("seq1")).agg(F.sum("l_quantity").alias("count0"))
    extra = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq0"), F.col("o_custkey").alias("seq1"), F.col("o_totalprice").alias("count0"))
    return pairs.pair_upsert(base, extra)


@query(f"""WITH e AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY {_key(9, 'event_id')}, event_id) AS rn, {_key(9, 'event_id')} AS k FROM events),
z AS (SELECT min(n) AS most FROM (SELECT count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 2)) SELECT event_id, event_type FROM e, z WHERE rn <= most ORDER BY rn, k, event_id LIMIT 700""")
def w10_stratified_sample(spark, sf_dir):
    return ranks.stratified_sample(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 700, 9, ["event_id"])


# -- evaluation --------------------------------------------------------------------------------------------

KMERS = f"""s AS (SELECT DISTINCT {LETTERS} AS seq FROM documents), b AS (SELECT DISTINCT {LETTERS} AS seq FROM benchmark),
kb AS (SELECT DISTINCT substr(seq, i, 11) AS k FROM (SELECT seq, unnest(range(1, length(seq) - 9)) AS i FROM b)),
ks AS (SELECT seq, substr(seq, i, 11) AS k FROM (SELECT seq, unnest(range(1, length(seq) - 9)) AS i FROM s)),
nov AS (SELECT s.seq, coalesce(n, 0) AS novelty FROM s LEFT JOIN (SELECT seq, count(*) AS n FROM ks WHERE k NOT IN (SELECT k FROM kb) GROUP BY seq) x ON x.seq = s.seq)"""


@query(f"WITH {KMERS} SELECT md5(seq) AS seq, novelty FROM nov")
def a4_kmer_novelty(spark, sf_dir):
    docs, known = (table(spark, sf_dir, t).select(letters("text").alias("seq")) for t in ("documents", "benchmark"))
    return evaluate.kmer_novelty(docs, known).select(F.md5(F.col("seq").cast("binary")).alias("seq"), "novelty")


@query(f"WITH {KMERS} SELECT md5(seq) AS seq, novelty FROM nov")
def a4_indexed_novelty(spark, sf_dir):
    """The same from a stored index of the known k-mers."""
    docs, known = (table(spark, sf_dir, t).select(letters("text").alias("seq")) for t in ("documents", "benchmark"))
    path = scratch_path(spark, "kmers")
    index = kmer_index.write_kmer_index(known, "kmers_" + path.rsplit("-", 1)[1], path)
    return kmer_index.indexed_novelty(docs, index).select(F.md5(F.col("seq").cast("binary")).alias("seq"), "novelty")


@query(f"WITH {KMERS}, r AS (SELECT DISTINCT source AS run, {LETTERS} AS seq FROM documents) SELECT run, round(avg(novelty), 6) AS novelty, count(*) AS n_valid FROM r JOIN nov ON r.seq = nov.seq GROUP BY run")
def a4_run_novelty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("run"), letters("text").alias("seq"))
    return evaluate.run_novelty(docs, table(spark, sf_dir, "benchmark").select(letters("text").alias("seq"))).withColumn("novelty", F.round("novelty", 6))


_SAME = "(a[i] = b[i] OR a[i] = 'X' OR b[i] = 'X' OR " + " OR ".join(f"({x}[i] = '{k}' AND {y}[i] IN ('{v[0]}', '{v[1]}'))" for k, v in mutations.AMBIGUOUS.items() for x, y in (("a", "b"), ("b", "a"))) + ")"
COMPATIBLE = f"len(list_filter(range(1, length(a) + 1), lambda i: NOT {_SAME})) = 0"


@query(f"""WITH s AS (SELECT doc_id, {LETTERS} AS a FROM documents), k AS (SELECT DISTINCT {LETTERS} AS b FROM documents WHERE lang = 'en'),
p AS (SELECT DISTINCT s.a, k.b FROM s JOIN k ON length(s.a) = length(k.b) WHERE s.a <> k.b AND s.a NOT IN (SELECT b FROM k)),
m AS (SELECT a, min(b) AS b FROM p WHERE {COMPATIBLE} GROUP BY a)
SELECT DISTINCT md5(s.a) AS seq, md5(coalesce(k.b, m.b)) AS matched, k.b IS NOT NULL AS exact FROM s LEFT JOIN k ON s.a = k.b LEFT JOIN m ON m.a = s.a""")
def j6_match_known(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", letters("text").alias("seq"))
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return matching.match_known(docs, docs.where("lang = 'en'")).select(digest("seq"), digest("matched"), "exact")


@query(f"""WITH {SAMPLES}, f AS (SELECT run, seq, min(rank) AS rank FROM samples GROUP BY run, seq),
p AS (SELECT DISTINCT x.run, x.seq AS a, y.seq AS b FROM f x JOIN f y ON x.run = y.run AND length(x.seq) = length(y.seq) AND y.rank < x.rank AND x.seq <> y.seq), bad AS (SELECT DISTINCT run, a FROM p WHERE {COMPATIBLE})
SELECT f.run, f.rank FROM f WHERE (run, seq) NOT IN (SELECT (run, a) FROM bad)""")
def w7_uniquify(spark, sf_dir):
    return matching.uniquify(samples(spark, sf_dir)).select("run", "rank")


#: Samples classified by what was known at a date: the steps, with the runs left open, and the flags.
CLASSIFY = f"""obs AS (SELECT {LETTERS} AS seq, DATE '2024-01-01' + CAST(doc_id % 200 AS INT) AS d, CAST(doc_id AS VARCHAR) AS acc, concat('q', CAST(n_chars % 97 AS VARCHAR)) AS lineage FROM documents),
runs AS ({{runs}}),
dates AS (SELECT lineage, min(d) AS first FROM (SELECT seq, arg_min(lineage, row(d, acc)) AS lineage, min(d) AS d FROM obs GROUP BY seq) GROUP BY lineage),
known AS (SELECT seq, count(*) AS n, min(d) AS d, string_agg(DISTINCT obs.lineage, ',' ORDER BY obs.lineage) AS ls, min(first) AS first FROM obs LEFT JOIN dates ON dates.lineage = obs.lineage GROUP BY seq),
o AS (SELECT seq AS b FROM known WHERE d <= DATE '2024-04-01'), w AS (SELECT seq AS b FROM known WHERE d > DATE '2024-04-01'), va AS (SELECT DISTINCT seq AS a FROM runs WHERE seq NOT LIKE '[%'),
po AS (SELECT a, min(b) AS b FROM va JOIN o ON length(a) = length(b) WHERE a = b OR ({COMPATIBLE}) AND a NOT IN (SELECT b FROM o) GROUP BY a),
pw AS (SELECT a, min(b) AS b FROM (SELECT a FROM va WHERE a NOT IN (SELECT a FROM po)) va JOIN w ON length(a) = length(b) WHERE a = b OR ({COMPATIBLE}) AND a NOT IN (SELECT b FROM w) GROUP BY a),
hit AS (SELECT a, b, 'old' AS age FROM po UNION ALL SELECT a, b, 'new' FROM pw),
kb AS (SELECT DISTINCT substr(b, i, 11) AS k FROM (SELECT b, unnest(range(1, length(b) - 9)) AS i FROM o)),
nv AS (SELECT a, count(*) AS n FROM (SELECT a, substr(a, i, 11) AS k FROM (SELECT a, unnest(range(1, length(a) - 9)) AS i FROM va)) WHERE k NOT IN (SELECT k FROM kb) GROUP BY a)"""
FLAGS = """SELECT run, runs.seq, score, coalesce(age = 'old', FALSE) AS old_seq, coalesce(age = 'new', FALSE) AS new_seq, age IS NULL AND runs.seq NOT LIKE '[%' AS false_seq, runs.seq LIKE '[%' AS invalid_seq, CASE WHEN hit.a = hit.b THEN known.n ELSE 0 END AS count, coalesce(nv.n, 0) AS novelty,
known.ls AS lineage, known.d AS seq_date, coalesce(known.first > DATE '2024-04-01', FALSE) AS new_lineage FROM runs LEFT JOIN hit ON hit.a = runs.seq LEFT JOIN known ON known.seq = hit.b LEFT JOIN nv ON nv.a = runs.seq"""
_RUNS = f"""SELECT source AS run, {LETTERS} AS seq, CAST(doc_id AS DOUBLE) AS score FROM documents UNION ALL SELECT 'benchmark', concat(CASE WHEN item_id % 5 = 0 THEN '[' ELSE '' END, {LETTERS}), CAST(item_id AS DOUBLE) FROM benchmark"""


@query(f"WITH {CLASSIFY.format(runs=_RUNS)}, flags AS ({FLAGS}) SELECT * EXCLUDE (seq) FROM flags")
def j7_classified_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("q"), (F.col("n_chars") % 97).cast("string")).alias("lang"), letters("text").alias("seq"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int"))
    obs = docs.select("seq", F.md5(F.col("seq").cast("binary")).alias("m"), day.alias("d"), F.col("doc_id").cast("string").alias("acc"), F.col("lang").alias("lineage"))
    runs = docs.union(table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.lit("benchmark"), F.lit(""), F.concat(F.when(F.col("item_id") % 5 == 0, "[").otherwise(""), letters("text")))).select(F.col("source").alias("run"), "seq", F.col("doc_id").cast("double").alias("score"))
    out = evaluate.classify_samples(runs, obs, "2024-04-01")
    return out.select("run", "score", "old_seq", "new_seq", "false_seq", "invalid_seq", "count", "novelty", F.array_join("lineage", ",").alias("lineage"), "seq_date", "new_lineage")


@query(f"""WITH {OBS}, {VARIANTS}, k AS (SELECT m, us AS u FROM units), old AS (SELECT k.* FROM k JOIN (SELECT m FROM obs GROUP BY m HAVING min(d) <= DATE '1995-01-08') USING (m)),
p AS (SELECT a.m, o.m AS closest, len(a.u) - len(o.u) AS distance FROM k a JOIN old o ON len(list_intersect(a.u, o.u)) = least(len(a.u), len(o.u))),
r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY abs(distance), distance, closest) AS rn FROM p)
SELECT k.m, closest, CAST(distance AS INT) AS distance FROM k LEFT JOIN r ON r.m = k.m AND rn = 1""")
def j8_closest_ancestor(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return matching.closest_ancestor(obs, splits.new_vs_old(obs, "1995-01-08").where("age = 'old'"))


NEW_LINE = "SELECT samples.*, (SELECT count(*) FROM ll WHERE ll.run = samples.run AND list_contains(samples.lineage, ll.l) AND ll.f < samples.rank) AS late FROM samples"
STATS = f"""{SAMPLES}, fs AS (SELECT run, seq, min(rank) AS rank FROM samples WHERE NOT invalid_seq GROUP BY run, seq), u AS (SELECT s.* FROM samples s JOIN fs USING (run, seq, rank)),
ul AS (SELECT run, rank, unnest(lineage) AS l FROM u), ll AS (SELECT run, l, min(rank) AS f FROM ul GROUP BY run, l),
late AS (SELECT ul.run, ul.rank, bool_or(ll.f < ul.rank) AS late FROM ul JOIN ll ON ul.run = ll.run AND ul.l = ll.l GROUP BY ul.run, ul.rank)"""


@query(f"""WITH {STATS} SELECT u.run, count(*) AS n_valid, count(*) FILTER (new_seq) AS n_new, count(*) FILTER (false_seq) AS n_false, count(*) FILTER (old_seq) AS n_old, round(avg(novelty), 9) AS avg_novelty,
round(count(*) FILTER (new_seq) / count(*), 9) AS new_rate, round(count(*) FILTER (new_seq) / greatest(count(*) FILTER (new_seq OR false_seq), 1e-12), 9) AS ppv, CAST(coalesce(sum(count) FILTER (new_seq), 0) AS BIGINT) AS counts, count(*) FILTER (NOT old_seq) AS n_non_old,
count(*) FILTER (new_seq AND new_lineage AND NOT late) AS n_new_lineages, count(*) FILTER (new_seq AND count >= 10) AS n_salient FROM u JOIN late ON u.run = late.run AND u.rank = late.rank GROUP BY u.run""")
def a6_run_stats(spark, sf_dir):
    out = evaluate.run_stats(samples(spark, sf_dir))
    return out.select("run", "n_valid", "n_new", "n_false", "n_old", F.round("avg_novelty", 9).alias("avg_novelty"), F.round("new_rate", 9).alias("new_rate"), F.round("ppv", 9).alias("ppv"), "counts", "n_non_old", "n_new_lineages", "n_salient")


# 97.5 % quantiles of Student's t by degrees of freedom, from 1.
_T = (12.70620474, 4.30265273, 3.18244631, 2.77644511, 2.57058184, 2.44691185, 2.36462425, 2.30600414, 2.26215716, 2.22813885, 2.20098516, 2.17881283, 2.16036866, 2.14478669, 2.13144955, 2.11990530, 2.10981558, 2.10092204, 2.09302405, 2.08596345)
T95 = " ".join(f"WHEN {n} THEN {t}" for n, t in enumerate(_T, 2))


@query(f"""WITH {STATS}, r AS (SELECT lang, run, count(*) FILTER (new_seq) AS v FROM u GROUP BY lang, run), g AS (SELECT lang, avg(v) AS mean, stddev_samp(v) AS s, count(*) AS n FROM r GROUP BY lang)
SELECT lang, round(mean, 9) AS mean, n, round(s / sqrt(n) * CASE n {T95} END, 6) AS err FROM g""")
def a7_mean_and_error(spark, sf_dir):
    first = matching.uniquify(samples(spark, sf_dir).where("not invalid_seq"), ambiguous=False)
    runs = first.groupBy("lang", "run").agg(F.count_if("new_seq").alias("v"))
    return evaluate.mean_ci(runs, ["lang"], "v").select("lang", F.round("mean", 9).alias("mean"), "n", F.round("err", 6).alias("err"))


CURVE = """SELECT run, rank, CAST(sum(CASE WHEN new_seq THEN 0 ELSE 1 END) OVER w AS BIGINT) AS fp, CAST(sum(CASE WHEN new_seq THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tp, CAST(sum(CASE WHEN new_seq THEN count ELSE 0 END) OVER w AS BIGINT) AS tp_count,
round(avg(CASE WHEN new_seq THEN 1.0 ELSE 0.0 END) OVER w, 9) AS rate FROM samples WHERE {what} WINDOW w AS (PARTITION BY run ORDER BY rank ROWS UNBOUNDED PRECEDING)"""


@query(f"WITH {SAMPLES} {CURVE.format(what='new_seq OR false_seq')}")
def w4_precision_curve_novel(spark, sf_dir):
    return evaluate.precision_curve(samples(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query(f"WITH {SAMPLES} {CURVE.format(what='NOT invalid_seq')}")
def w4_precision_curve_all(spark, sf_dir):
    return evaluate.precision_curve(samples(spark, sf_dir), "ALL").withColumn("rate", F.round("rate", 9))


@query("""WITH b AS (SELECT l_returnflag AS run, l_partkey AS child, max(l_quantity) AS metric FROM lineitem GROUP BY 1, 2), x AS (SELECT * FROM b WHERE child NOT IN (SELECT p_partkey FROM part WHERE p_size < 5)),
s AS (SELECT run, metric, count(*) FILTER (child IN (SELECT p_partkey FROM part WHERE p_size > 30)) AS t, count(*) AS n FROM x GROUP BY run, metric)
SELECT run, metric, CAST(sum(n - t) OVER w AS BIGINT) AS fp, CAST(sum(t) OVER w AS BIGINT) AS tp FROM s WINDOW w AS (PARTITION BY run ORDER BY metric DESC)""")
def w5_discovery_curve(spark, sf_dir):
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("child")).agg(F.max("l_quantity").alias("metric"))
    part = table(spark, sf_dir, "part")
    pick = lambda c: part.where(c).select(F.col("p_partkey").alias("child"))
    return evaluate.discovery_curve(best, pick("p_size > 30"), pick("p_size < 5"))


def _period_sql(cumulative: bool) -> str:
    names = ("case_counts", "seq_counts", "lineage_counts", "salient_counts")
    w = "OVER (PARTITION BY run ORDER BY period ROWS UNBOUNDED PRECEDING)"
    full = ", ".join(f"CAST({f'sum(coalesce({n}, 0)) {w}' if cumulative else f'coalesce({n}, 0)'} AS BIGINT) AS {n}" for n in names)
    return f"""WITH {HITS}, h AS (SELECT *, CAST(ceil((seq_date - DATE '2024-01-05') / 7.0) AS INT) AS period, row_number() OVER (PARTITION BY run ORDER BY seq_date, score DESC, seq) AS pos FROM hits), k AS (SELECT *, lineage[1] AS l FROM h WHERE period BETWEEN 1 AND 4),
f AS (SELECT run, l, min(pos) AS f FROM k WHERE new_lineage GROUP BY run, l),
g AS (SELECT k.run, period, sum(count) AS case_counts, count(*) AS seq_counts, count(*) FILTER (new_lineage AND pos = f.f) AS lineage_counts, count(*) FILTER (count >= 10) AS salient_counts FROM k LEFT JOIN f ON f.run = k.run AND f.l = k.l GROUP BY k.run, period),
d AS (SELECT run, CAST(unnest(range(1, 5)) AS INT) AS period FROM (SELECT DISTINCT run FROM hits)), z AS (SELECT d.run, d.period, {", ".join("g." + n for n in names)} FROM d LEFT JOIN g ON g.run = d.run AND g.period = d.period),
y AS (SELECT run, period, {full} FROM z) SELECT *, round(CASE WHEN seq_counts > 0 THEN salient_counts / seq_counts ELSE 0 END, 9) AS salient_ratio FROM y"""


@query(_period_sql(False))
def a8_period_stats(spark, sf_dir):
    return evaluate.period_stats(hits(spark, sf_dir), "2024-01-05", 4).withColumn("salient_ratio", F.round("salient_ratio", 9))


@query(_period_sql(True))
def a8_period_stats_cumulative(spark, sf_dir):
    return evaluate.period_stats(hits(spark, sf_dir), "2024-01-05", 4, cumulative=True).withColumn("salient_ratio", F.round("salient_ratio", 9))


@query(f"""WITH {OBS}, v AS (SELECT m, CAST(floor((min(d) - DATE '1995-01-02' - 1) / 7.0) + 1 AS INT) AS week, count(*) AS n FROM obs GROUP BY m), hit AS (SELECT DISTINCT location AS run, m FROM obs WHERE d > DATE '1995-06-01'),
f AS (SELECT run, week, count(*) AS found, count(*) FILTER (n >= 300) AS salient FROM hit JOIN v USING (m) WHERE week BETWEEN 1 AND 6 GROUP BY run, week), a AS (SELECT week, count(*) AS all_found FROM v WHERE week BETWEEN 1 AND 6 GROUP BY week),
g AS (SELECT run, CAST(unnest(range(1, 7)) AS INT) AS week FROM (SELECT DISTINCT run FROM hit))
SELECT g.run, g.week, coalesce(found, 0) AS found, coalesce(salient, 0) AS salient, coalesce(all_found, 0) AS all_found, round(coalesce(found, 0) / greatest(coalesce(all_found, 0), 1e-12), 9) AS recall, CAST(sum(coalesce(found, 0)) OVER (PARTITION BY g.run ORDER BY g.week) AS BIGINT) AS found_so_far
FROM g LEFT JOIN f ON f.run = g.run AND f.week = g.week LEFT JOIN a ON a.week = g.week""")
def a9_weekly_recall(spark, sf_dir):
    obs = observations(spark, sf_dir)
    hit = obs.where("d > date '1995-06-01'").select(F.col("location").alias("run"), "m").distinct().withColumn("new_seq", F.lit(True))
    out = evaluate.weekly_recall(hit, obs, "1995-01-02", 6, 300)
    return out.select("run", "week", "found", "salient", "all_found", F.round("recall", 9).alias("recall"), "found_so_far")


@query("""WITH x AS (SELECT documents.doc_id, CASE WHEN n_chars >= 2000 THEN 1 ELSE 0 END AS y, CASE WHEN toxic IS NULL THEN -100.0 ELSE (n_chars * 31 + documents.doc_id * 17) % 1000 END AS s FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS ar FROM x)
SELECT round((sum(ar) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM r""")
def a12_roc_auc(spark, sf_dir):
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    scores = docs.join(labels, "doc_id").select(F.col("doc_id").alias("m"), ((F.col("n_chars") * 31 + F.col("doc_id") * 17) % 1000).cast("double").alias("score"))
    return evaluate.roc_auc(scores, docs.select(F.col("doc_id").alias("m"), F.col("n_chars").alias("count")), cutoff=2000).withColumn("auc", F.round("auc", 9))


_DISCRETE = "(CASE " + " ".join(f"WHEN {{x}} >= {a} AND {{x}} < {b} THEN {i}" for i, (a, b) in reversed(list(enumerate(RANGES)))) + " ELSE 0 END)"


@query(f"""WITH x AS (SELECT CAST((doc_id * 37) % 100 AS DOUBLE) / 100 AS pred, CASE WHEN doc_id % 2 = 0 THEN CAST(quality AS DOUBLE) ELSE CAST(doc_id % 99 + 1 AS DOUBLE) / 100.5 END AS label FROM labels),
y AS (SELECT unnest(['overall', CASE WHEN label IN (0, 1) THEN 'fake' ELSE 'real' END]) AS part, {_DISCRETE.format(x='label')} AS t, {_DISCRETE.format(x='pred')} AS p FROM x),
c AS (SELECT part, c, sum(CASE WHEN t = c AND p = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t = c THEN 1 ELSE 0 END + CASE WHEN p = c THEN 1 ELSE 0 END) AS tot FROM y, (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY part, c),
m AS (SELECT part, avg(2 * tp / tot) AS macro_f1 FROM c WHERE tot > 0 GROUP BY part)
SELECT y.part, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 9) AS micro_f1, round(any_value(macro_f1), 9) AS macro_f1, count(*) AS n FROM y JOIN m ON m.part = y.part GROUP BY y.part""")
def a13_classification_report(spark, sf_dir):
    k = F.col("doc_id")
    label = F.when(k % 2 == 0, F.col("quality").cast("double")).otherwise((k % 99 + 1).cast("double") / 100.5)
    rows = table(spark, sf_dir, "labels").select(((k * 37 % 100).cast("double") / 100).alias("pred"), label.alias("label"))
    return evaluate.classification_report(rows, RANGES).select("part", F.round("micro_f1", 9).alias("micro_f1"), F.round("macro_f1", 9).alias("macro_f1"), "n")


@query("WITH s AS (SELECT (l_quantity * 7) / 50 AS p, l_discount > 0.02 AS v, l_tax > 0.04 AS k FROM lineitem) SELECT round(sum(CASE WHEN v THEN p ELSE 0 END) / count(*), 7) AS mean_valid, round(sum(CASE WHEN v AND NOT k THEN p ELSE 0 END) / count(*), 7) AS mean_novel, count(*) FILTER (v) AS n_valid, count(*) FILTER (v AND NOT k) AS n_novel, count(*) AS n FROM s")
def a15_score_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 7 / 50).alias("potential"), (F.col("l_discount") > 0.02).alias("valid"), (F.col("l_tax") > 0.04).alias("known"))
    return evaluate.score_summary(rows).withColumn("mean_valid", F.round("mean_valid", 7)).withColumn("mean_novel", F.round("mean_novel", 7))


_QUANTILES = [0.1, 0.25, 0.5, 0.9]


@query(f"""WITH s AS (SELECT event_id, value AS score, user_id % 10 = 0 AS known FROM events), r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS n FROM s),
c AS (SELECT [{", ".join(f"(SELECT score FROM r WHERE rn = ceil({q}::DOUBLE * n))" for q in _QUANTILES)}] AS c)
SELECT event_id, CAST(CASE WHEN known THEN 5 WHEN score >= c[1] THEN 4 WHEN score >= c[2] THEN 3 WHEN score >= c[3] THEN 2 WHEN score >= c[4] THEN 1 ELSE 0 END AS INT) AS quantile FROM s, c""")
def a16_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("score"), (F.col("user_id") % 10 == 0).alias("known"))
    return evaluate.assign_quantile(rows, evaluate.quantile_bounds(rows, _QUANTILES)).select("event_id", "quantile")


@query(f"""WITH r AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS tool, CAST(l_suppkey AS VARCHAR) AS run FROM lineitem), m AS (SELECT tool, run, concat(tool, '/', (row_number() OVER (PARTITION BY tool ORDER BY {_key(0, 'run')}, run) - 1) % 5) AS merged_run FROM r)
SELECT tool, merged_run, count(*) AS n FROM lineitem JOIN m ON m.tool = CAST(l_linenumber AS VARCHAR) AND m.run = CAST(l_suppkey AS VARCHAR) GROUP BY tool, merged_run""")
def a17_merged_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("tool"), F.col("l_suppkey").cast("string").alias("run"))
    return evaluate.merge_runs(rows, "tool", 5).groupBy("tool", "merged_run").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_linenumber AS generation, l_partkey AS child, max(row(l_extendedprice, l_orderkey)) AS b FROM lineitem GROUP BY 1, 2), c AS (SELECT child, max(row(b[1], generation, b[2])) AS b FROM b GROUP BY child)
SELECT child, b[2] AS generation, b[3] AS parent, b[1] AS metric FROM c""")
def w8_best_per_child(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("generation"), F.col("l_partkey").alias("child"), F.col("l_orderkey").alias("parent"), F.col("l_extendedprice").alias("ll"))
    return evaluate.collapse(evaluate.best_per_child(rows))


@query("""WITH s AS (SELECT o_custkey AS orig, l_partkey AS seq, l_orderkey AS parent, l_extendedprice + o_totalprice AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey), b AS (SELECT orig, seq, max(row(score, parent)) AS b FROM s WHERE seq NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY orig, seq),
r AS (SELECT orig, seq, b[2] AS parent, b[1] AS score, row_number() OVER (PARTITION BY orig ORDER BY b[1] DESC, seq) AS rank FROM b) SELECT orig, seq, parent, round(score, 2) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def w9_next_generation(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parents = orders.select(F.col("o_custkey").alias("orig"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("score"))
    made = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("orig"), F.col("l_partkey").alias("seq"), F.col("l_orderkey").alias("parent"), F.col("l_extendedprice").alias("score"))
    gone = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("seq"))
    return evaluate.next_generation(made, parents, gone, 3).withColumn("score", F.round("score", 2))


# -- joins with metadata -----------------------------------------------------------------------------------


@query("SELECT l_orderkey AS acc, c_name AS virus_name, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def j9_metadata_join(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("acc"), F.col("c_name").alias("virus_name"))
    return audit.metadata_join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("acc"), "l_partkey"), meta).select("acc", "virus_name", "l_partkey")


@query("""WITH j AS (SELECT c_name, c_mktsegment AS lineage, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'MACHINERY' ELSE c_mktsegment END AS n FROM customer)
SELECT count(*) AS n, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n IS NULL OR n <> lineage) AS mismatches, count(*) FILTER (n <> lineage) AS mismatches_known FROM j""")
def j10_reassignment_audit(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    reports = people.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("taxon"), F.when(F.col("c_custkey") % 3 == 0, "MACHINERY").otherwise(F.col("c_mktsegment")).alias("lineage"))
    return audit.reassignment_audit(people.select(F.concat("c_name", F.lit("|2024")).alias("virus_name"), F.col("c_mktsegment").alias("lineage")), reports)


@query("SELECT source AS run, count(*) AS n, round(avg(toxic), 9) AS metric FROM documents JOIN labels USING (doc_id) GROUP BY source")
def j12_attached_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("run"), F.col("doc_id").alias("seq"))
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), F.col("toxic").alias("score"))
    return evaluate.attach_scores(docs, scores).groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg("metric"), 9).alias("metric"))


@query("""WITH s AS (SELECT l_suppkey, count(*) / (SELECT count(*) FROM lineitem) AS share FROM lineitem GROUP BY l_suppkey) SELECT l_linenumber AS generation, round(sum(l_discount + CASE WHEN l_linenumber = 1 THEN ln(share) ELSE 0 END), 4) AS metric FROM lineitem JOIN s USING (l_suppkey) GROUP BY l_linenumber""")
def j13_prior(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    shares = series.prevalence(line.select(F.col("l_suppkey").alias("seq")), "seq")
    rows = line.select(F.col("l_suppkey").alias("parent"), F.col("l_linenumber").alias("generation"), F.col("l_discount").alias("metric"))
    return evaluate.add_prior(rows, shares).groupBy("generation").agg(F.round(F.sum("metric"), 4).alias("metric"))


@query(f"SELECT doc_id, {_key(11, 'doc_id', 'lang')} AS key FROM documents")
def rand_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rand_key(11, "doc_id", "lang").alias("key"))


# -- records, clusters, and the smaller columns ------------------------------------------------------------


@query("SELECT concat('d', CAST(doc_id AS VARCHAR), '|', lang) AS header, CAST(length(text) AS INT) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j11_select_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("|", F.concat(F.lit("d"), F.col("doc_id").cast("string")), "lang").alias("header"), F.col("text").alias("sequence"))
    names = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    return fasta.select_records(docs, names)[0].select("header", F.length("sequence").alias("n"))


@query("SELECT CAST(l_partkey AS VARCHAR) AS id, max(s_name) AS cluster FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey")
def j14_cluster_members(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    entries = rows.groupBy(F.col("s_name").alias("cluster")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("members100"))
    return cluster_files.cluster_members(entries)


_COVERED = "(a[i] = b[i] OR a[i] = 'X' OR " + " OR ".join(f"(a[i] = '{k}' AND b[i] IN ('{v[0]}', '{v[1]}'))" for k, v in mutations.AMBIGUOUS.items()) + ")"


@query(f"""WITH {OBS}, {VARIANTS}, {SEQUENCES}, o AS (SELECT split_part(acc, '-', 1) AS acc, m FROM obs), f AS (SELECT acc, min(m) AS first FROM o GROUP BY acc),
p AS (SELECT DISTINCT first, m FROM o JOIN f USING (acc)), ok AS (SELECT first, p.m, length(a) = length(b) AND len(list_filter(range(1, length(a) + 1), lambda i: NOT {_COVERED})) = 0 AS ok
  FROM (SELECT p.*, x.seq AS a, y.seq AS b FROM p JOIN seqs x ON x.m = first JOIN seqs y ON y.m = p.m) p)
SELECT o.m, count(*) AS n, count(*) FILTER (ok AND CAST(o.acc AS BIGINT) % 7 <> 0) AS ok FROM o JOIN f USING (acc) JOIN ok ON ok.first = f.first AND ok.m = o.m GROUP BY o.m""")
def j1_label_reconstruction(spark, sf_dir):
    obs = observations(spark, sf_dir).select("acc", "m").withColumn("acc", F.substring_index("acc", "-", 1))
    reference = REFERENCE
    seen = mutations.apply_mutations(obs.groupBy("acc").agg(F.min("m").alias("m")), reference)
    records = seen.select(F.concat(F.lit("h|EPI_ISL_"), "acc", F.lit("|x")).alias("header"), F.col("seq").alias("sequence")).where("split(header, '[|_]')[3] % 7 <> 0")
    return audit.label_reconstruction(obs, records, reference).groupBy("m").agg(F.count("*").alias("n"), F.count_if("reconstructed").alias("ok"))


@query(f"""WITH {OBS}, {VARIANTS}, far AS (SELECT arg_max(m, row(len(us), m)) AS far, arg_max(us, row(len(us), m)) AS fu FROM units)
SELECT m AS given, TRUE AS round_trip, CAST(len(us) + len(fu) - 2 * len(list_intersect(us, fu)) AS INT) AS distance, CAST(CASE WHEN len(list_intersect(us, fu)) = len(us) THEN len(fu) - len(us) END AS INT) AS added FROM units, far""")
def f12_f13_alignment_and_distance(spark, sf_dir):
    """An alignment may stand for other mutations of the same score, so it is held to give the sequence back."""
    # Stored: the largest of the distinct keys is that of all rows to the optimizer, which would cut every row into units.
    keys = stored(observations(spark, sf_dir).select("m").distinct(), "keys")
    seqs = mutations.apply_mutations(keys.withColumnRenamed("m", "given"), REFERENCE, "given")
    again = mutations.apply_mutations(mutations.align_mutations(seqs, REFERENCE), REFERENCE, "m", "again")
    far = keys.agg(F.max(F.struct(F.size(mutations.mutation_units("m")), "m")).alias("f")).select(F.col("f.m").alias("far"))  # one row
    rows = again.join(F.broadcast(far)).withColumn("round_trip", F.col("seq") == F.col("again"))
    rows = mutations.edit_distance(mutations.edit_distance(rows, "given", "far"), "given", "far", "added", insert_only=True)
    return rows.select("given", "round_trip", "distance", "added")


@query(f"""WITH s AS (SELECT doc_id, {LETTERS} AS seq, {_key(12, 'doc_id')} AS k FROM documents), c AS (SELECT doc_id, seq, CASE WHEN length(seq) > 1023 THEN k % (length(seq) - 1022) ELSE 0 END AS start FROM s),
h AS (SELECT doc_id, substr(seq, start + 1, 1023) AS t FROM c)
SELECT doc_id, CAST(length(t) + 1 AS INT) AS n, md5(t) AS held FROM h""")
def f15_pad_or_crop(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.pad_or_crop(letters("text"), 1024, rand_key(12, "doc_id")).alias("x"))
    alphabet = F.split(F.lit(tokens.LETTERS + "?*"), "")
    n = F.aggregate("x.attention_mask", F.lit(0), lambda a, m: a + m)
    text = F.array_join(F.transform(F.slice("x.input_ids", F.lit(2), n - 1), lambda i: F.get(alphabet, i)), "")
    return rows.select("doc_id", n.alias("n"), F.md5(text.cast("binary")).alias("held"))


@query(f"""WITH RECURSIVE {OBS}, {VARIANTS}, {SEQUENCES}, sp AS (SELECT m, CASE WHEN ref = 'ins' THEN greatest(0, pos + s - 1) WHEN alt = 'del' THEN greatest(0, pos + s - 2) ELSE greatest(0, pos + s - 1) END AS x,
CASE WHEN ref = 'ins' THEN pos + s + length(alt) + 1 WHEN alt = 'del' THEN pos + s ELSE pos + s - 1 + length(alt) END AS y FROM summed WHERE fresh = 1),
{_tiles_sql("seqs", "m", 6, 1, 40)},
e AS (SELECT t.m, a, k, EXISTS (SELECT 1 FROM sp WHERE sp.m = t.m AND x < a + k AND y > a AND y > x) AS hit, row_number() OVER (PARTITION BY t.m ORDER BY {_key("6-extra", "h", "i - 1")}, i) AS r FROM t WHERE i > 0),
c AS (SELECT *, greatest(2, count(*) FILTER (hit) OVER (PARTITION BY m)) AS extra FROM e)
SELECT m, a AS mask_start, k AS mask_length FROM c WHERE hit UNION ALL SELECT m, a, k FROM c WHERE r <= extra""")
def f20_selected_tiles(spark, sf_dir):
    seqs = mutations.apply_mutations(observations(spark, sf_dir).select("m").distinct(), REFERENCE)
    rows = mutations.changed_spans(seqs)
    return tokens.tile_masks(rows, seed=6, shortest=1, longest=40, spans="spans", least_extra=2).select("m", "mask_start", "mask_length")


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(concat(text, '<|endoftext|>'), '<\\|endoftext\\|>', '', 'g'), '[ \\t\\n\\r\\f\\v]+', '', 'g'), '\\*+$', '*')) AS seq FROM documents")
def f22_clean_generated(spark, sf_dir):
    cleaned = tokens.clean_generated(F.concat("text", F.lit("<|endoftext|>")), "marker")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned.cast("binary")).alias("seq"))


@query(f"WITH {PAIRS}, p AS (SELECT *, count1 / (count0 + count1) AS share FROM pairs WHERE greatest(count0, count1) >= 500 AND seq0 NOT LIKE '%stop%' AND seq1 NOT LIKE '%stop%') SELECT seq0, seq1, round(share, 9) AS label, CAST({_BRACKET.format(x='count1 / count0')} AS INT) AS tolerance, CAST({_DISCRETE.format(x='share')} AS INT) AS class, length(seq0) = length(seq1) AS same_length, len(list_filter(string_split(seq1, ','), lambda t: (t LIKE '%del' OR t LIKE 'ins%') AND NOT contains(seq0, t))) > 0 AS extra_indel FROM p")
def f24_f25_f26_pair_labels(spark, sf_dir):
    rows = tables.filter_pairs(_pairs(spark, sf_dir), min_max=500)
    label = pairs.pair_label("count0", "count1")
    return rows.select("seq0", "seq1", F.round(label, 9).alias("label"), pairs.bracket(F.col("count1") / F.col("count0")).alias("tolerance"), tokens.discretise(label, RANGES).alias("class"), series.same_length("seq0", "seq1").alias("same_length"), series.has_extra_indel("seq0", "seq1").alias("extra_indel"))


@query(f"WITH {STATS} SELECT u.run, u.rank, new_seq AND new_lineage AND NOT late AS counts_lineage FROM u JOIN late ON u.run = late.run AND u.rank = late.rank")
def w6_new_lineage_flags(spark, sf_dir):
    rows = samples(spark, sf_dir).where("not invalid_seq")
    return evaluate.new_lineage_flags(matching.uniquify(rows, ambiguous=False)).select("run", "rank", "counts_lineage")


@query(f"WITH {SAMPLES}, c AS (SELECT run, rank, row_number() OVER (PARTITION BY run ORDER BY rank) AS place, sum(CASE WHEN new_seq THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY rank) AS tp FROM samples WHERE NOT invalid_seq) SELECT run, CAST(place AS INT) AS place, CAST(tp AS BIGINT) AS tp FROM c WHERE place IN (1, 5, 10, 50)")
def w4_curve_at_ranks(spark, sf_dir):
    return evaluate.at_ranks(evaluate.precision_curve(samples(spark, sf_dir), "ALL"), [1, 5, 10, 50]).select("run", "place", "tp")


@query("WITH c AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS a FROM orders GROUP BY o_custkey) SELECT o_custkey, round(coalesce(a[1], 0), 2) AS w1, round(coalesce(a[2], 0), 2) AS w2, round(coalesce(a[20], 0), 2) AS w20 FROM c")
def f23_leading_weeks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("a"))
    held = tokens.pad_leading_weeks(F.transform("a", lambda s: s["o_totalprice"]), 20)
    return rows.select("o_custkey", held.alias("h")).select("o_custkey", *[F.round(F.get("h", i - 1), 2).alias(f"w{i}") for i in (1, 2, 20)])


@query("SELECT canonical, count(*) AS n FROM (SELECT concat_ws(',', concat('A_', chr(CAST(65 + l_suppkey % 20 AS INT)), '3T'), concat('Spike_C', CAST(10 + l_linenumber AS INT), 'D')) AS canonical FROM lineitem) GROUP BY canonical")
def f2_canonical_mutations(spark, sf_dir):
    text = F.expr("concat('(Spike_C', cast(10 + l_linenumber as int), 'D, A_', chr(cast(65 + l_suppkey % 20 as int)), '3T)')")
    return table(spark, sf_dir, "lineitem").select(mutations.canonical_mutations(text).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("n"))


# -- the other modes of operators --------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN instr(t, '*') > 0 THEN substr(t, 1, instr(t, '*')) ELSE t END AS ended, CASE WHEN doc_id % 3 = 0 THEN concat(lang, '*') END AS framed FROM (SELECT doc_id, lang, concat(lang, CASE WHEN doc_id % 2 = 0 THEN '*' ELSE '' END, source, '**') AS t FROM documents)")
def f22_ended_and_framed(spark, sf_dir):
    k = F.col("doc_id")
    ended = F.concat("lang", F.when(k % 2 == 0, "*").otherwise(""), "source", F.lit("**"))
    framed = F.concat(F.when(k % 3 == 0, "1").otherwise("0"), "lang", F.lit("2"), F.lit("rest"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.clean_generated(ended, "end").alias("ended"), tokens.clean_generated(framed, "framed").alias("framed"))


@query(f"""WITH s AS (SELECT doc_id, {LETTERS} AS seq FROM documents), h AS (SELECT doc_id, seq, substr(seq, 1, 510) AS t FROM s WHERE length(seq) <= 510)
SELECT doc_id, CAST(length(seq) + 2 AS INT) AS n_mask, md5(t) AS held FROM h""")
def f15_pool_form(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", letters("text").alias("seq"))
    rows = tokens.made_once(docs, tokens.pool_form(tokens.encode("seq", 512), 512, F.lit(30)), "x").where("x is not null")
    alphabet = F.split(F.lit(tokens.LETTERS + "?*"), "")
    n = F.aggregate("x.attention_mask", F.lit(0), lambda a, m: a + m)
    text = F.array_join(F.transform(F.slice("x.input_ids", F.lit(3), n - 2), lambda i: F.get(alphabet, i)), "")
    return rows.select("doc_id", n.alias("n_mask"), F.md5(text.cast("binary")).alias("held"))


@query(f"WITH {OBS} SELECT DISTINCT m, CASE WHEN d <= DATE '1998-01-15' THEN 'old' ELSE 'new' END AS age FROM obs")
def e8_new_vs_old_by_row(spark, sf_dir):
    return splits.new_vs_old(observations(spark, sf_dir), "1998-01-15", by_first_seen=False)


@query(f"""WITH {OBS}, c AS (SELECT lineage, count(*) AS total FROM obs GROUP BY lineage), r AS (SELECT lineage, (row_number() OVER (ORDER BY total DESC, lineage DESC) - 1) // 4 AS block FROM c),
s AS (SELECT lineage, row_number() OVER (PARTITION BY block ORDER BY {_key(2, 'lineage')}, lineage) AS pos FROM r), p AS (SELECT lineage, CASE WHEN pos <= 3 THEN 'train' ELSE 'val' END AS split FROM s),
j AS (SELECT m, lineage, count(*) AS n, any_value(split) AS split FROM obs JOIN p USING (lineage) GROUP BY m, lineage)
SELECT * FROM j WHERE split = 'train' OR m NOT IN (SELECT m FROM j WHERE split = 'train')""")
def w3_split_without_test(spark, sf_dir):
    return splits.split_by_lineage(observations(spark, sf_dir), 3, 1, 0, seed=2)


@query(f"""WITH {PAIRS}, far AS (SELECT seq0, seq1, count0, count1, period FROM pairs WHERE count0 >= 600)
SELECT f.seq0, f.seq1, period, (SELECT string_agg(CAST(c AS BIGINT), ',' ORDER BY cum.w) FROM cum WHERE m = f.seq0 AND cum.w BETWEEN cum.week AND {LAST_WEEK}) AS weekly0,
(SELECT string_agg(CAST(c AS BIGINT), ',' ORDER BY cum.w) FROM cum WHERE m = f.seq1 AND cum.w BETWEEN cum.week AND {LAST_WEEK}) AS weekly1 FROM far f""")
def j2_with_weekly_counts(spark, sf_dir):
    rows = _pairs(spark, sf_dir, with_weekly=True).where("count0 >= 600")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    return rows.select("seq0", "seq1", "period", text("weekly_counts0").alias("weekly0"), text("weekly_counts1").alias("weekly1"))


@query("""WITH r AS (SELECT c_name AS taxon, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE c_mktsegment END AS lineage FROM customer WHERE c_custkey % 5 <> 0)
SELECT count(*) AS n, count(*) FILTER (lineage IS NULL) AS missing, count(*) FILTER (lineage IS NULL OR lineage <> c_mktsegment) AS mismatches, count(*) FILTER (lineage <> c_mktsegment) AS mismatches_known FROM customer LEFT JOIN r ON taxon = c_name""")
def j10_repeated_reports(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    first = people.where("c_custkey % 5 <> 0").select(F.col("c_name").alias("taxon"), F.col("c_mktsegment").alias("lineage"), F.lit("a").alias("file"), F.col("c_custkey").alias("row"))
    again = first.where("row % 2 = 0").select("taxon", F.lit("b").alias("lineage"), F.lit("b").alias("file"), "row")
    return audit.reassignment_audit(people.select(F.concat("c_name", F.lit("|2024")).alias("virus_name"), F.col("c_mktsegment").alias("lineage")), tables.last_reports(again.union(first)))
