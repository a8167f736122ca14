"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words and word beginnings) is mined from labelled training rows by log-odds; the features are
its density, how near its hits are to the second person, capitals, punctuation and obfuscation rates. Trees
and calibration come from a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.llm.common import stored

SAMPLE_ROWS = 12_000
THRESHOLD = 0.3
NEAR = 5
STEMS = (4, 5, 6, 7, 8)
#: An entry needs these log-odds and this log-likelihood ratio against the base rate, lest rare words enter by chance.
LEAST_LOG_ODDS, LEAST_EVIDENCE = 2.5, 16.0
FEATURES = ("hits", "weight", "strongest", "density", "distinct", "share_near_you", "you_density", "capitals", "shouted", "marks", "exclaims", "runs_of_marks", "obfuscated", "obfuscated_hits", "log_words")
# Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer eure sie ihnen usted ustedes vosotros vuestro tú ti".split())
# Signs that stand for letters.
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "*": None, ".": None, "-": None, "_": None})
WORD = re.compile(r"[^\s,;:?\"()\[\]{}|]+")
EDGES = ".!*#%&$-_'`~+"
RUN = re.compile(r"[!?*#$%&@]{2,}")
UPPER, LOWER = (bytes(range(a, a + 26)) for a in (65, 97))
MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # a null id has no labels


def pieces(word: str) -> list[str]:
    """What of a word can be a lexicon entry: the word itself and its beginnings, marked by a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def mine_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entry -> log-odds, from rows (text, toxic), counted by documents; bounded by the sample's toxic rows."""

    @F.pandas_udf("array<string>")
    def entries(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({p for w in {w.strip(EDGES) for w in WORD.findall((t or "").lower())} if len(w) > 2 for p in pieces(w)}))

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = sample.select("toxic", F.explode(entries("text")).alias("entry")).groupBy("entry")
    counts = counts.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t > 0")
    base, n = n1 / max(1, n0 + n1), F.col("t") + F.col("c")
    evidence = F.col("t") * F.log(F.col("t") / n / base) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    return {r.entry: r.odds for r in counts.where(evidence >= LEAST_EVIDENCE).select("entry", odds.alias("odds")).where(F.col("odds") >= LEAST_LOG_ODDS).collect()}


def measure(text: str | None, lexicon: dict[str, float], starts: frozenset[str]) -> list[float]:
    """The features of a text, in the order of FEATURES; all 0 without words. ``starts``: of lexicon entries."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    hits, found, masked, masked_hits = [], {}, 0, 0
    weight = lambda w: max((lexicon[p] for p in pieces(w) if p in lexicon), default=0.0) if w[:3] in starts else 0.0
    for i, w in enumerate(words):
        plain = w.isalpha()
        if not plain:
            w = w.strip(EDGES)
            plain = w.isalpha()
        if w[:3] in starts and (odds := weight(w)):
            hits.append(i)
            found[w] = odds
        elif not plain and w and not w.isdigit():
            masked += 1
            w = w.translate(LEET)
            if odds := weight(w):
                masked_hits += 1
                hits.append(i)
                found[w] = odds
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    you = sum(w in SECOND_PERSON for w in words) if hits else 0
    raw = text.encode()
    size = len(raw)
    upper = size - len(raw.translate(None, UPPER))
    letters = upper + size - len(raw.translate(None, LOWER))
    marks = size - len(raw.translate(None, MARKS))
    shouted = sum(w.isupper() and len(w) > 2 for w in text.split()) if upper > n else 0
    return [
        float(len(hits)), sum(found.values()), max(found.values(), default=0.0), len(hits) / n, float(len(found)), near / max(1, len(hits)), you / n, upper / max(1, letters), shouted / n, marks / size,
        text.count("!") / n, len(RUN.findall(text)) / n, masked / n, masked_hits / n, float(np.log1p(n)),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], name: str = "features") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((lexicon, frozenset(e[:3] for e in lexicon)))

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: measure(t, *held.value))

    return docs.withColumn(name, features("text"))


class Model:
    """Lexicon, trees and calibration; a constant score where only one class was labelled."""

    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None, steps: tuple[list[float], list[float]], constant: float):
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, steps, constant

    def scored(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with the calibrated score in ``name``."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.constant))
        rows = with_features(docs, self.lexicon, "_llm_features").withColumn("_llm_vector", array_to_vector("_llm_features"))
        trees = self.trees.setFeaturesCol("_llm_vector").setPredictionCol("_llm_p").setRawPredictionCol("_llm_raw").setProbabilityCol("_llm_prob")
        rows = trees.transform(rows).withColumn(name, _interpolate(vector_to_array("_llm_prob")[1], *self.steps))
        return rows.select(*docs.columns, name)


def _interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """The isotonic fit at x, linear between its at most 64 kept points."""
    out = F.lit(float(ys[-1]))
    for (a, fa), (b, fb) in reversed(list(zip(zip(xs, ys), zip(xs[1:], ys[1:])))):
        out = F.when(x < b, fa + (fb - fa) * (x - a) / (b - a)).otherwise(out)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).otherwise(out)


def isotonic(points: list[tuple[float, int]]) -> tuple[list[float], list[float]]:
    """Pool-adjacent-violators fit of label on raw score, as at most 64 points of rising x.

    Each pool is shrunk towards the base rate by one row, so no score is exactly 0 or 1.
    """
    points = sorted(points)
    base = sum(y for _, y in points) / len(points)
    pools: list[list[float]] = []
    for x, y in points:
        if pools and pools[-1][3] == x:
            pools[-1][0] += y
            pools[-1][1] += 1
        else:
            pools.append([y, 1, x, x])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    step = max(1, len(pools) // 30)
    xs, ys = [], []
    for s, n, low, high in pools[::step] + ([pools[-1]] if (len(pools) - 1) % step else []):
        for x in dict.fromkeys((low, high)):
            if not xs or x > xs[-1]:
                xs.append(x)
                ys.append(max((s + base) / (n + 1), ys[-1] if ys else 0.0))
    return xs, ys


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 4) -> Model:
    """Learn from at most ``sample_rows`` labelled rows that aren't held out, the first in a hashed order.

    Three quarters of the sample grow the lexicon and the trees, the rest calibrates. Labels that are null,
    or that contradict each other for a doc_id, are left out; repeated labels count once, and repeated rows of
    documents each. Without labels, or with one class only, the score is constant: the share of toxic labels,
    0 for none. Null, empty and very long texts are measured whole like others; other columns are left alone.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    known = known.withColumn("_o", F.xxhash64(F.lit(5), "doc_id")).orderBy("_o", "doc_id").limit(sample_rows)
    known = known.withColumn("grow", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(4)) < 3)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most sample_rows rows
    sample = stored(sample.select("text", F.col("toxic").cast("int").alias("toxic"), "grow"), "labelled")
    rates = {r["grow"]: (r["n"], r["t"]) for r in sample.groupBy("grow").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    n, t = (sum(v[i] for v in rates.values()) for i in (0, 1))
    if any(g not in rates or rates[g][1] in (0, rates[g][0]) for g in (True, False)):
        return Model({}, None, ([], []), t / n if n else 0.0)
    grow = sample.where("grow")
    lexicon = mine_lexicon(grow)
    rows = stored(with_features(sample, lexicon).select("grow", F.col("toxic").cast("double").alias("label"), "features"), "features")
    rows = rows.withColumn("vector", array_to_vector("features"))
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=64, seed=3, cacheNodeIds=False).fit(rows.where("grow").coalesce(1))  # at most sample_rows short rows; one order of sums
    checked = model.transform(rows.where("not grow")).select(vector_to_array("probability")[1].alias("p"), "label").collect()  # a quarter of the sample
    return Model(lexicon, model, isotonic([(r.p, int(r.label)) for r in checked]), t / n)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or above; null and empty texts are scored like others."""
    return fit(docs, labels).scored(docs, "_llm_score").where(F.col("_llm_score") < threshold).select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = fit(docs, labels).scored(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
