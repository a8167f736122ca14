"""Queries of the sources, sinks and jobs: the driver tables go through files in the shared folder and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqtrend.functions import mutations
from seqtrend.jobs import audit as audit_job
from seqtrend.jobs import evaluate as evaluate_job
from seqtrend.jobs import make_corpus, make_pairs, make_splits, normalise
from seqtrend.plans.queries import AGREED, AGREED_BY, CLASSIFY, COMPATIBLE, FISHER, FLAGS, LAST_WEEK, PAIRS, T95, _frequent_rare_sql, _key, _negatives_sql, _pairs, _split_pairs_sql, query
from seqtrend.plans.roles import CLUSTERS, LETTERS, OBS, REFERENCE, SEQUENCES, VARIANTS, clusters, letters, observations, table
from seqtrend.sources import clusters as cluster_files
from seqtrend.sources import fasta, tables
from seqtrend.sources.scratch import scratch_path, stored


def _raw(spark, sf_dir) -> str:
    """A raw table of the observations: two spellings of the host and another host, missing lineages, other proteins."""
    path, k = scratch_path(spark, "raw"), F.substring_index("acc", "-", 1).cast("long")
    spike = F.array_join(F.transform(F.reverse(mutations.tokens("m")), lambda t: F.concat(F.lit("Spike_"), t)), ",")
    rows = observations(spark, sf_dir).select(
        F.col("acc").alias("Accession ID"), F.concat(F.lit("virus-"), "acc").alias("Virus name"), F.when(k % 3 == 0, "Human").when(k % 3 == 1, "human").otherwise("Bat").alias("Host"), F.col("location").alias("Location"),
        F.col("d").cast("string").alias("Submission date"), F.date_format("d", "yyyy-MM").alias("Collection date"), F.when(k % 10 == 0, "NA").otherwise(F.col("lineage")).alias("Pango lineage"),
        F.concat(F.lit("(NSP3_A5T,"), spike, F.lit(")")).alias("AA Substitutions"),
    )
    rows.write.csv(path, sep="\t", header=True)
    return path


_NORMAL = f"{OBS}, kept AS (SELECT * FROM obs WHERE CAST(split_part(acc, '-', 1) AS BIGINT) % 3 <> 2 AND CAST(split_part(acc, '-', 1) AS BIGINT) % 10 <> 0)"


@query(f"WITH {_NORMAL} SELECT acc, concat('virus-', acc) AS virus_name, location, lineage, d, m FROM kept WHERE d BETWEEN DATE '1996-03-10' AND DATE '1996-07-20'")
def s1_s9_normalised_window(spark, sf_dir):
    out = scratch_path(spark, "normalised")
    normalise.run(spark, _raw(spark, sf_dir), out)
    return tables.load_normalised(spark, out, "1996-03-10", "1996-07-20")


_SNAPSHOTS = ("NOT (month IN ('1995-03', '1996-07') AND line % 2 = 1) AND month <> '1997-05'", "month <> '1994-01'")


@query(f"""WITH {OBS}, o AS (SELECT *, strftime(d, '%Y-%m') AS month, CAST(split_part(acc, '-', 2) AS INT) AS line FROM obs),
a AS (SELECT month, count(*) AS n FROM o WHERE {_SNAPSHOTS[0]} GROUP BY month), b AS (SELECT month, count(*) AS n, count(DISTINCT m) AS variants FROM o WHERE {_SNAPSHOTS[1]} GROUP BY month)
SELECT b.month, b.n, variants, a.n IS NULL OR a.n <> b.n AS rewritten FROM b LEFT JOIN a USING (month)""")
def s9_refreshed_snapshot(spark, sf_dir):
    """Two snapshots, of which the second changes two months, adds one and lacks one; whether a month has new files."""
    rows = observations(spark, sf_dir).withColumn("virus_name", F.lit("v")).withColumn("month", F.date_format("d", "yyyy-MM")).withColumn("line", F.split("acc", "-")[1].cast("int"))
    out, one, two = scratch_path(spark, "snapshots"), *(rows.where(x).select("acc", "virus_name", "location", "lineage", "d", "m") for x in _SNAPSHOTS)
    held = lambda: spark.read.schema("m string, month string").parquet(out)
    files = lambda: held().groupBy("month").agg(F.array_sort(F.collect_set("_metadata.file_name")).alias("files"))
    tables.write_normalised(one, out)
    before = stored(files().select(F.col("month").alias("_month"), F.col("files").alias("_files")), "files")
    tables.refresh_normalised(two, out)
    after = held().groupBy("month").agg(F.count("*").alias("n"), F.countDistinct("m").alias("variants")).join(files(), "month")
    same = F.col("files").eqNullSafe(F.col("_files"))
    return after.join(F.broadcast(before), F.col("month") == F.col("_month"), "left").select("month", "n", "variants", (~same).alias("rewritten"))  # a row a month


@query(f"WITH {_NORMAL} SELECT acc FROM kept")
def s13_exported_accessions(spark, sf_dir):
    out = scratch_path(spark, "accessions")
    tables.export_accessions(tables.normalise(tables.read_observations(spark, _raw(spark, sf_dir))), out)
    return spark.read.text(out).select(F.col("value").alias("acc"))


@query(f"""WITH {OBS}, {VARIANTS}, {SEQUENCES}, n AS (SELECT m, count(*) AS n FROM obs GROUP BY m), e AS (SELECT m, unnest(range(0, n)) AS i FROM n)
SELECT concat(CASE WHEN m = '' THEN 'REF' ELSE replace(m, ',', '_') END, '_', CAST(i AS VARCHAR)) AS header, md5(seq) AS seq FROM e JOIN seqs USING (m)""")
def s2_s10_fasta(spark, sf_dir):
    out = scratch_path(spark, "fasta")
    fasta.write_fasta(mutations.apply_mutations(observations(spark, sf_dir).select("m"), REFERENCE), out, compression="gzip")
    return fasta.read_fasta(spark, out).select("header", F.md5(F.col("sequence").cast("binary")).alias("seq"))


@query("SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS id, c_name AS name, CAST(c_custkey % 50 AS BIGINT) AS size, c_mktsegment AS taxonomy, CAST(c_nationkey AS VARCHAR) AS taxonomy_id, concat('R', CAST(c_custkey AS VARCHAR)) AS representative FROM customer")
def s3_cluster_headers(spark, sf_dir):
    out, k = scratch_path(spark, "headers"), F.col("c_custkey").cast("string")
    line = F.concat(F.lit(">C"), k, F.lit(" "), "c_name", F.lit(" n="), (F.col("c_custkey") % 50).cast("string"), F.lit(" Tax="), "c_mktsegment", F.lit(" TaxID="), F.col("c_nationkey").cast("string"), F.lit(" RepID=R"), k)
    table(spark, sf_dir, "customer").select(F.concat(line, F.lit("\nACGT")).alias("value")).write.text(out)
    return fasta.read_cluster_headers(spark, out)


#: Members of one XML file, some 40 MB.
XML_MEMBERS = 250_000


def xml_files(members: int) -> int:
    return max(16, -(-members // XML_MEMBERS))


@query("SELECT DISTINCT s_name AS cluster, concat('P', CAST(l_partkey AS VARCHAR)) AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def s4_cluster_xml(spark, sf_dir):
    out = scratch_path(spark, "xml")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_name", F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("p"))
    one = lambda p: F.concat(F.lit('<dbReference type="UniProtKB ID" id="x"><property type="UniRef100 ID" value="'), p, F.lit('"/><property type="other" value="y"/></dbReference>'))
    entries = rows.groupBy("s_name").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    members = F.array_join(F.transform(F.slice("ps", F.lit(2), F.greatest(F.size("ps") - 1, F.lit(0))), lambda p: F.concat(F.lit("<member>"), one(p), F.lit("</member>"))), "")
    text = F.concat(F.lit('<entry id="'), "s_name", F.lit('"><representativeMember>'), one(F.get("ps", F.lit(0))), F.lit("</representativeMember>"), members, F.lit("</entry>"))
    # A file is read by one task: their number grows with the table.
    n = xml_files(table(spark, sf_dir, "lineitem").count())
    entries = entries.select(F.pmod(F.xxhash64("s_name"), F.lit(n)).alias("bucket"), F.lit(1).alias("at"), text.alias("value"))
    ends = spark.range(n).select(F.col("id").alias("bucket"), F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("<root>").alias("value")), F.struct(F.lit(2).alias("at"), F.lit("</root>").alias("value")))).alias("e")).select("bucket", "e.*")
    entries.unionByName(ends).repartition("bucket").sortWithinPartitions("bucket", "at").select("bucket", "value").write.partitionBy("bucket").text(out)
    return cluster_files.read_cluster_xml(spark, out).select("cluster", F.explode("members100").alias("member"))


@query(f"SELECT source AS run, md5({LETTERS}) AS seq, CAST(doc_id AS DOUBLE) / 8 AS score FROM documents")
def s5_samples(spark, sf_dir):
    """Run is the file's name: files are named by the folder their run was written to."""
    out = scratch_path(spark, "samples")
    table(spark, sf_dir, "documents").select(letters("text").alias("seq"), (F.col("doc_id") / 8).alias("ll"), F.col("source")).write.partitionBy("source").json(out)
    rows = tables.read_samples(spark, out, level=-2)
    return rows.select(F.replace("run", F.lit("source="), F.lit("")).alias("run"), F.md5(F.col("seq").cast("binary")).alias("seq"), "score")


@query("""WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_linenumber % 2 + 1 AS generation FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, generation ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS rank FROM g)
SELECT CAST(l_orderkey AS VARCHAR) AS orig_sequence, CAST(generation AS INT) AS generation, CAST(rank AS INT) AS rank, CAST(l_suppkey AS VARCHAR) AS parent, CAST(l_partkey AS VARCHAR) AS child, l_extendedprice AS ll FROM r""")
def s6_generations(spark, sf_dir):
    out = scratch_path(spark, "generations")
    line = table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_linenumber") % 2)
    part = lambda i: F.transform(F.array_sort(F.collect_list(F.when(F.col("g") == i, F.struct("l_partkey", "l_suppkey", "l_extendedprice")))), lambda s: F.struct(s["l_suppkey"].cast("string").alias("parent"), s["l_partkey"].cast("string").alias("child"), s["l_extendedprice"].alias("ll")))
    root = F.array(F.struct(F.lit("").alias("parent"), F.lit("root").alias("child"), F.lit(0.0).alias("ll")))
    line.groupBy("l_orderkey").agg(F.array(root, part(0), part(1)).alias("generations")).select(F.col("l_orderkey").cast("string").alias("orig_sequence"), "generations").write.json(out)
    return tables.read_generations(spark, out).select("orig_sequence", "generation", "rank", "parent", "child", "ll")


@query("SELECT c_name AS taxon, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS lineage FROM customer")
def s7_reports(spark, sf_dir):
    out, people = scratch_path(spark, "reports"), table(spark, sf_dir, "customer")
    people.select(F.col("c_name").alias("taxon"), F.col("c_mktsegment").alias("lineage")).write.csv(f"{out}/a/first", header=True)
    people.where("c_custkey % 3 = 0").select(F.col("c_name").alias("taxon"), F.lit("NEW").alias("lineage")).write.csv(f"{out}/b/again", header=True)
    return tables.read_assignment_reports(spark, out)


@query(f"""WITH {PAIRS}, s AS (SELECT *, CASE WHEN period % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_key(13, 'seq0', 'seq1')}, seq0, seq1) AS rn FROM s)
SELECT seq0, count0, seq1, count1, period FROM r WHERE rn <= 300 AND greatest(count0, count1) >= 550 AND least(count0, count1) >= 500 AND seq0 NOT LIKE '%stop%' AND seq1 NOT LIKE '%stop%'""")
def s8_s11_pairs(spark, sf_dir):
    out = scratch_path(spark, "pairs")
    tables.write_pairs(_pairs(spark, sf_dir).withColumn("split", F.when(F.col("period") % 2 == 0, "train").otherwise("val")), out, 300, 13)
    return tables.read_pairs(spark, out, 550, 500).select("seq0", "count0", "seq1", "count1", "period")


_CORPUS = f"""{CLUSTERS}, rec AS (SELECT doc_id, {LETTERS} AS seq, CAST(('0x' || right(sha256(cluster), 8)) AS BIGINT) % 10000 AS b FROM documents JOIN clusters ON id = CAST(doc_id AS VARCHAR)),
pl AS (SELECT *, CASE WHEN b < 7000 THEN 'train' WHEN b < 9000 THEN 'val' ELSE 'test' END AS data_type FROM rec), ch AS (SELECT doc_id, data_type, rtrim(seq, '*') AS seq FROM pl),
pc AS (SELECT doc_id, data_type, i AS fragment, substr(seq, i * 500 + 1, 500) AS piece FROM (SELECT *, unnest(range(0, CAST(ceil(length(seq) / 500.0) AS BIGINT))) AS i FROM ch)),
l AS (SELECT *, reverse(piece) AS rev, unnest(range(1, 22)) AS n FROM pc), an AS (SELECT doc_id, data_type, fragment, piece, min(n) FILTER (n <= length(piece) AND instr(substr(piece, 2), substr(piece, 1, n)) = 0) AS a,
 min(n) FILTER (n <= length(piece) AND instr(substr(rev, 2), substr(rev, 1, n)) = 0) AS b FROM l GROUP BY doc_id, data_type, fragment, piece),
x AS (SELECT *, least(length(piece) // 2, 50, length(piece) - 2, length(piece) - a - b) AS most FROM an WHERE a IS NOT NULL AND b IS NOT NULL), y AS (SELECT *, 1 + {_key(5, 'piece')} % most AS k FROM x WHERE most >= 1),
z AS (SELECT *, length(piece) - k - a - b + 1 AS room FROM y), ex AS (SELECT *, a + {_key(6, 'piece')} % room AS start FROM z WHERE room > 0)"""


def _corpus(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), letters("text").alias("seq"))
    return make_corpus.run(records, clusters(spark, sf_dir), [0.7, 0.2, 0.1], 500, seed=5)


@query(f"WITH {_CORPUS} SELECT data_type, count(*) AS count FROM ex GROUP BY data_type")
def s12_written_examples(spark, sf_dir):
    return tables.write_examples(_corpus(spark, sf_dir), scratch_path(spark, "examples"))


@query(f"WITH {_CORPUS} SELECT CAST(doc_id AS VARCHAR) AS id, CAST(fragment AS INT) AS fragment, data_type, CAST(length(piece) AS INT) AS n, CAST(start AS INT) AS mask_start, concat(substr(piece, start + 1, k), '[MASK]') AS decoder FROM ex")
def job_make_corpus(spark, sf_dir):
    return _corpus(spark, sf_dir).select("id", "fragment", "data_type", F.size("ids").alias("n"), "mask_start", F.array_join("decoder", "").alias("decoder"))


@query(f"WITH {_NORMAL} SELECT strftime(d, '%Y-%m') AS month, count(*) AS n, count(DISTINCT m) AS variants FROM kept GROUP BY 1")
def job_normalise(spark, sf_dir):
    rows = normalise.run(spark, _raw(spark, sf_dir), scratch_path(spark, "normalised"))
    return rows.groupBy(F.date_format("d", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.countDistinct("m").alias("variants"))


@query(f"""WITH {OBS}, {VARIANTS}, {SEQUENCES}, o AS (SELECT * FROM obs WHERE d <= DATE '2000-06-30' AND m NOT LIKE '%stop%'), c AS (SELECT lineage, count(*) AS total FROM o GROUP BY lineage),
r AS (SELECT lineage, (row_number() OVER (ORDER BY total DESC, lineage DESC) - 1) // 10 AS block FROM c), s AS (SELECT lineage, row_number() OVER (PARTITION BY block ORDER BY {_key(1, 'lineage')}, lineage) AS pos FROM r),
p AS (SELECT lineage, CASE WHEN pos <= 1 THEN 'train' WHEN pos <= 9 THEN 'val' ELSE 'test' END AS split FROM s), v2 AS (SELECT m, lineage, count(*) AS n, max(d) AS last FROM o GROUP BY m, lineage), j AS (SELECT v2.*, split FROM v2 JOIN p USING (lineage)),
k AS (SELECT split, m, sum(n) AS n FROM j WHERE (split = 'train' OR m NOT IN (SELECT m FROM j WHERE split = 'train')) AND last >= DATE '1997-01-01' GROUP BY split, m)
SELECT split, k.m, md5(seq) AS seq, CAST(n AS BIGINT) AS n FROM k JOIN seqs USING (m)""")
def job_make_splits(spark, sf_dir):
    made = make_splits.run(observations(spark, sf_dir), REFERENCE, (1, 8, 1), "2000-06-30", "1997-01-01", True, 1)
    return made.groupBy("split", "m", F.md5(F.col("seq").cast("binary")).alias("seq")).agg(F.count("*").alias("n"))


@query(f"""WITH {AGREED}, {FISHER}, {VARIANTS}, agreed AS ({AGREED_BY.format(test="p >= 0.1")}), {_split_pairs_sql(3, "tot")},
kn AS (SELECT agreed.*, a.split FROM agreed JOIN sp a ON a.m = seq0 JOIN sp b ON b.m = seq1 WHERE a.split = b.split),
cn AS (SELECT m, count(*) AS total FROM obs GROUP BY m), {_frequent_rare_sql(3, "kn", 7, 600, 599)}, {_negatives_sql(3, "fr", 2, 2)}
SELECT * FROM fr UNION ALL SELECT * FROM fake""")
def job_make_pairs(spark, sf_dir):
    """The regions are the even and the odd orders. All pairs are made, and all are held against both."""
    obs = observations(spark, sf_dir).withColumn("location", F.when(F.substring_index("acc", "-", 1).cast("long") % 2 == 0, "ASIA").otherwise("EUROPE"))
    frequent = make_pairs.Frequent(min_count=600, max_total=599, trailing=0, most_rare=7)
    return make_pairs.run(obs, "ASIA", "~ASIA", last_week=LAST_WEEK, blocks=(4, 1, 1), how="union", p_value=0.1, frequent=frequent, n_mutations=2, trials=(2, 2), seed=3)


_FIGURES = ["n_valid", "n_new", "n_false", "n_old", "avg_novelty", "old_rate", "new_rate", "ppv", "counts", "n_non_old", "n_new_lineages", "count_per_forecast", "count_per_novel", "n_salient"]
_EVALUATED = f"""{CLASSIFY.format(runs=f"SELECT concat(CASE WHEN doc_id % 2 = 0 THEN 'one-' ELSE 'two-' END, source) AS run, {LETTERS} AS seq, CAST(doc_id AS DOUBLE) AS score FROM documents")},
flags AS ({FLAGS}), ranked AS (SELECT * REPLACE (string_split(lineage, ',') AS lineage), row_number() OVER (PARTITION BY run ORDER BY score DESC, seq) AS rank FROM flags WHERE NOT invalid_seq),
f AS (SELECT run, seq, min(rank) AS rank FROM ranked GROUP BY run, seq),
near AS (SELECT DISTINCT x.run, x.seq AS a, y.seq AS b FROM f x JOIN f y ON x.run = y.run AND length(x.seq) = length(y.seq) AND y.rank < x.rank AND x.seq <> y.seq), lower AS (SELECT DISTINCT run, a FROM near WHERE {COMPATIBLE}),
u AS (SELECT ranked.* FROM ranked JOIN f USING (run, seq, rank) WHERE (run, seq) NOT IN (SELECT (run, a) FROM lower)),
ul AS (SELECT run, rank, unnest(lineage) AS l FROM u), ll AS (SELECT run, l, min(rank) AS f FROM ul GROUP BY run, l),
late AS (SELECT ul.run, ul.rank, bool_or(ll.f < ul.rank) AS late FROM ul JOIN ll ON ul.run = ll.run AND ul.l = ll.l GROUP BY ul.run, ul.rank),
st AS (SELECT u.run, count(*) AS n_valid, count(*) FILTER (new_seq) AS n_new, count(*) FILTER (false_seq) AS n_false, count(*) FILTER (old_seq) AS n_old, avg(novelty) AS avg_novelty, coalesce(sum(count) FILTER (new_seq), 0) AS counts,
  count(*) FILTER (NOT old_seq) AS n_non_old, count(*) FILTER (new_seq AND new_lineage AND NOT coalesce(late, FALSE)) AS n_new_lineages, count(*) FILTER (new_seq AND count >= 10) AS n_salient
  FROM u LEFT JOIN late ON u.run = late.run AND u.rank = late.rank GROUP BY u.run),
full_st AS (SELECT *, n_old / n_valid AS old_rate, n_new / n_valid AS new_rate, CASE WHEN n_new + n_false > 0 THEN n_new / (n_new + n_false) ELSE 0 END AS ppv,
  CASE WHEN n_new > 0 THEN counts / n_new ELSE 0 END AS count_per_forecast, CASE WHEN n_non_old > 0 THEN counts / n_non_old ELSE 0 END AS count_per_novel FROM st)"""


@query(f"""WITH {_EVALUATED}, figures AS ({" UNION ALL ".join(f"SELECT split_part(run, '-', 1) AS tool, '{x}' AS figure, CAST({x} AS DOUBLE) AS v FROM full_st" for x in _FIGURES)}),
g AS (SELECT tool, figure, avg(v) AS mean, stddev_samp(v) AS s, count(*) AS n FROM figures GROUP BY tool, figure)
SELECT tool, figure, round(mean, 7) AS mean, round(s / sqrt(n) * CASE n {T95} END, 5) AS err, n FROM g""")
def job_evaluate(spark, sf_dir):
    out = _evaluated(spark, sf_dir)["means"]
    return out.select("tool", "figure", F.round("mean", 7).alias("mean"), F.round("err", 5).alias("err"), "n")


@query(f"""WITH {_EVALUATED}, c AS (SELECT run, row_number() OVER w AS place, count(*) FILTER (new_seq) OVER w AS tp, count(*) FILTER (NOT new_seq) OVER w AS fp, coalesce(sum(count) FILTER (new_seq) OVER w, 0) AS tp_count
  FROM u WHERE new_seq OR NOT invalid_seq WINDOW w AS (PARTITION BY run ORDER BY rank)),
short AS (SELECT tool, min(n) AS n FROM (SELECT split_part(run, '-', 1) AS tool, run, max(place) AS n FROM c GROUP BY run) GROUP BY tool),
v AS (SELECT split_part(run, '-', 1) AS tool, place, unnest(['tp', 'fp', 'tp_count', 'rate']) AS figure, unnest([CAST(tp AS DOUBLE), CAST(fp AS DOUBLE), CAST(tp_count AS DOUBLE), tp / (tp + fp)]) AS x FROM c),
g AS (SELECT v.tool, figure, place, avg(x) AS mean, stddev_samp(x) AS s, count(*) AS n FROM v JOIN short ON short.tool = v.tool AND place <= short.n GROUP BY v.tool, figure, place)
SELECT tool, figure, CAST(place AS INT) AS place, round(mean, 7) AS mean, round(s / sqrt(n) * CASE n {T95} END, 5) AS err, n FROM g""")
def job_evaluate_curves(spark, sf_dir):
    """Means of the curves over all valid samples, place by place."""
    out = _evaluated(spark, sf_dir)["curve_means"].where("kind = 'ALL'")
    return out.select("tool", "figure", F.col("place").cast("int").alias("place"), F.round("mean", 7).alias("mean"), F.round("err", 5).alias("err"), "n")


def _evaluated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("q"), (F.col("n_chars") % 97).cast("string")).alias("lineage"), letters("text").alias("seq"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 200).cast("int"))
    obs = docs.select("seq", F.md5(F.col("seq").cast("binary")).alias("m"), day.alias("d"), F.col("doc_id").cast("string").alias("acc"), "lineage")
    runs = docs.select(F.concat(F.when(F.col("doc_id") % 2 == 0, "one-").otherwise("two-"), "source").alias("run"), "seq", F.col("doc_id").cast("double").alias("score"))
    return evaluate_job.run(runs, obs, "2024-04-01")


@query("""WITH j AS (SELECT o_orderkey, c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS n FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT count(*) AS n, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n IS NULL OR n <> c_mktsegment) AS mismatches, count(*) FILTER (n <> c_mktsegment) AS mismatches_known FROM j""")
def job_audit(spark, sf_dir):
    orders, people = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    meta = orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("acc"), F.concat("c_name", F.lit("|x")).alias("virus_name"), F.col("c_mktsegment").alias("lineage"))
    return audit_job.run(orders.select(F.col("o_orderkey").alias("acc")), meta, s7_reports(spark, sf_dir))[0]
