"""Source divergence: how far the word shares of a language's sources lie apart, with repeated texts collapsed.

Identical texts of a language are one row with a count per source. Each is cut into terms once; its terms
then count as often as the text occurs, in documents and in all. Pairs of sources are compared sparsely: a
sum over all kept terms is made of what absent terms give, which depends on a term's count alone and so is
taken from histograms of the counts, and of a correction for the terms that both sources hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqtrend.llm.common import BROADCAST_ROWS, small, stored

LEAST_DOCUMENTS, TOP = 10, 10
SCALE, PRIOR = 1_000_000_000, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII letters and of all that is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = rb"[a-z\x80-\xff]+"  # the same in UTF-8, lower-cased
#: Different terms that a task holds at once.
TASK_TERMS = 300_000
WHOLE = "decimal(38,0)"


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)); decimals hold the product at any size."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + PRIOR)
    return F.call_function("div", over.cast(WHOLE), (total + PRIOR * terms).cast(WHOLE)) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); with shares up to SCALE + 1 the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def text_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): documents (lang, source, text, k) with the texts' SHA-256, and (lang, k, source, m), how many there are of each."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(clean("lang").alias("lang"), clean("source").alias("source"), clean("text").alias("text")).withColumn("k", F.unhex(F.sha2("text", 256)))
    return rows, stored(rows.groupBy("lang", "k", "source").agg(F.count("*").alias("m")), "texts")


def collapsed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, text, sources): the distinct texts of every language with the number of documents per source.

    Where the texts that repeat were counted as few, their digests are broadcast, and a text that is alone in its
    language stays in its task; repeated ones meet by their digest, and one of equal texts leaves each task.
    Else all meet that way.
    """
    sources = F.collect_list(F.struct("source", "m")).alias("sources")  # as many as the language has sources
    held = counts.groupBy("lang", "k").agg(F.sum("m").alias("n"), sources)
    often = stored(held.where("n > 1").drop("n"), "repeated")
    meet = lambda part, table: part.groupBy("lang", "k").agg(F.first("text").alias("text")).join(table, ["lang", "k"]).select("lang", "text", "sources")
    if often.count() > BROADCAST_ROWS:
        return meet(rows, held)
    digests = F.broadcast(often.select("lang", "k"))
    alone = rows.join(digests, ["lang", "k"], "left_anti").select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("m"))).alias("sources"))
    return alone.unionByName(meet(rows.join(digests, ["lang", "k"], "left_semi"), often))


def _counted(batches: Iterator[pa.RecordBatch], most: int = TASK_TERMS) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, handed on whenever they have over ``most`` terms."""
    lower, term = bytes.maketrans(UPPER.encode(), LOWER.encode()), re.compile(TERM_BYTES)
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            names = pa.array(terms, pa.binary()).cast(pa.string())
            n, d = (pa.array([x[i] for x in terms.values()], pa.int64()) for i in (0, 1))
            repeat = lambda v: pa.array([v], pa.string()).take(pa.array(np.zeros(len(terms), np.int32)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([repeat(lang), names, repeat(source), n, d], ["lang", "term", "source", "n", "d"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, text, sources in zip(batch.column("lang").to_pylist(), batch.column("text"), batch.column("sources").to_pylist()):
            found = Counter(term.findall(text.as_py().translate(lower)))
            for s in sources:
                terms, m = held.setdefault((lang, s["source"]), {}), s["m"]
                before = len(terms)
                for word, n in found.items():
                    if (x := terms.get(word)) is None:
                        terms[word] = [n * m, m]
                    else:
                        x[0] += n * m
                        x[1] += m
                size += len(terms) - before
            if size > most:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, source, n, d): occurrences and documents of every term, from collapsed texts, each cut into terms once.

    Terms are looked for in UTF-8, where a character beyond ASCII is bytes of 128 and more. A task adds up before
    it hands on; a third of the texts in one group are so many additions and few rows.
    """
    rows = texts.select("lang", F.col("text").cast("binary").alias("text"), "sources")
    parts = rows.mapInArrow(_counted, "lang string, term string, source string, n long, d long")
    return parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): per source of a language its distance to each other source (part
    ``pair``), and the ``top`` terms by which it exceeds the language (part ``term``).

    ``docs`` has text, lang and source; null ones are ''; other columns are left out. Kept are a language's
    terms in at least ``least_documents`` of its documents, repeated rows counting each. A group without terms
    takes part with counts of 0; a language without kept terms has pairs of value 0 and no terms. Ties go to
    the smaller item. An empty table stays empty.
    """
    rows, documents = text_counts(docs)
    groups = documents.select("lang", "source").distinct()
    counts = stored(term_counts(collapsed(rows, documents)), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all")).where(F.col("d") >= least_documents).drop("d")
    kept = stored(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("lang_total"))
    posts = counts.join(kept, ["lang", "term"]).select("lang", "term", "source", "n", "all")
    held = stored(posts, "postings")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.join(small(langs), "lang", "left").join(small(totals), ["lang", "source"], "left").select("lang", "source", zero("terms"), zero("lang_total"), zero("total"), zero("own"))
    # z: the share of a term that the group doesn't have.
    groups = stored(groups.withColumn("z", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))), "groups")
    shares = held.join(small(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    shares = stored(shares.withColumn("q", share(F.col("all"), F.col("lang_total"), F.col("terms"))).select("lang", "term", "source", "p", "q", "z"), "shares")

    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.unionByName(pairs(groups, shares).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))).select("lang", "source", "part", "item", "value", "rank")


def pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value): every ordered pair of a language's groups with the sum over all its kept terms.

    All terms of the one as if the other had none of them, and the reverse, the terms that neither has, and for
    each term of both the difference to that.
    """
    a = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), F.col("own").alias("na"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.col("own").alias("nb"))
    both = a.join(small(b), "lang").where("a < b")  # the pairs that are asked for
    value = lambda p, q: apart(F.col(p), F.col(q))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))

    def alone(mine: str, other: str) -> DataFrame:
        rows = histogram.join(small(groups.select("lang", F.col("source").alias("_o"), F.col("z").alias("_z"))), "lang").where("source <> _o")
        sums = rows.groupBy("lang", F.col("source").alias(mine), F.col("_o").alias(other)).agg(F.sum(F.col("n") * value("p", "_z")).alias(f"only_{mine}"))
        return sums.where("a < b")

    x = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    y = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    met = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b")
    met = met.agg(F.sum(value("pa", "pb") - value("pa", "zb") - value("za", "pb") + value("za", "zb")).alias("common"))
    for part in (alone("a", "b"), alone("b", "a"), met):
        both = both.join(part, ["lang", "a", "b"], "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    neither = F.when(F.col("terms") > 0, (F.col("terms") - F.col("na") - F.col("nb")) * value("za", "zb")).otherwise(0)
    both = both.select("lang", "a", "b", (some("only_a") + some("only_b") + some("common") + neither).cast("long").alias("value"))
    return both.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), "value"), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), "value"))))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every document by itself, and every kept term for every pair.
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, kept.n AS all_n, sum(coalesce(n.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (
  SELECT lang, source, term, n, CAST(1 + {SCALE}::HUGEINT * (n + {PRIOR}) // (dense.total + {PRIOR} * v.v) AS BIGINT) AS p,
         CAST(1 + {SCALE}::HUGEINT * (all_n + {PRIOR}) // (v.total + {PRIOR} * v.v) AS BIGINT) AS q
  FROM dense JOIN v USING (lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
