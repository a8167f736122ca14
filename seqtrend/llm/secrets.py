"""Secret scans: fixed rules, and character Markov models of random strings and of ordinary identifiers.

Only DataFrame functions run. The two first-order models are trained from labelled samples: what the rules
matched, and generated strings, are random; the other tokens of a bounded sample of documents, identifiers
put together from its words, and numbers are ordinary. A token is a secret if the log-likelihood ratio of the models
exceeds ``prior_log_odds``: how much rarer secrets are held to be than ordinary tokens of that length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.llm.common import let, match_spans

# The rules' patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"  # maximal runs: the same as AKIA[A-Z0-9]+ of 16 or more
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"
LEAST_TOKEN, TRAIN_TOKEN = 16, 8
LOG_ODDS = 16.0
SAMPLE_DOCS, SAMPLE_STRINGS, SAMPLE_NUMBERS = 2000, 3000, 500


def base_spans(text: Column) -> Column:
    """struct<assign,access,hex>: the rules' spans of each kind."""
    text = F.coalesce(text, F.lit(""))
    assigns = text.contains(":") | text.contains("=")  # every match of ASSIGN has one
    assign = match_spans(F.when(assigns, text).otherwise(""), ASSIGN)
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    access = match_spans(F.when(text.contains("AKIA"), text).otherwise(""), ACCESS)
    return F.struct(assign.alias("assign"), access.alias("access"), match_spans(text, HEX).alias("hex"))


def _outside(tokens: Column, base: Column) -> Column:
    every = F.concat(base["assign"], base["access"], base["hex"])
    return let(every, lambda b: F.filter(tokens, lambda t: ~F.exists(b, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))))


def labelled_tokens(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(random, token) from at most ``sample_docs`` documents, generated random strings, identifiers, numbers and runs of one character.

    The documents are those with the smallest hashes of id and text; of repeats of one row so many as fit. Null
    and empty texts give nothing, an empty table leaves the generated strings.
    """
    order = F.xxhash64(F.lit(31), F.col("doc_id"), F.col("text"))
    last = docs.select(order.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]  # one number
    sample = docs.where(order <= F.lit(last)).select("text").limit(sample_docs)
    sample = sample.select("text", base_spans(F.col("text")).alias("base"))
    values = F.concat(F.transform("base.assign", lambda s: F.regexp_extract(s["value"], ASSIGN, 2)), F.transform("base.access", lambda s: s["value"]), F.transform("base.hex", lambda s: s["value"]))
    secret = sample.select(F.lit(True).alias("random"), F.explode(values).alias("token")).where(F.length("token") >= LEAST_TOKEN)
    plain = _outside(match_spans(F.coalesce("text", F.lit("")), TOKEN % TRAIN_TOKEN), F.col("base"))
    plain = sample.select(F.lit(False).alias("random"), F.explode(F.transform(plain, lambda s: s["value"])).alias("token"))
    digest = F.unhex(F.sha2(F.concat(F.lit("seqtrend-"), F.col("id")), 256))
    forms = F.when(F.col("id") % 4 == 0, F.upper(F.base64(digest))).when(F.col("id") % 4 == 1, F.hex(digest)).when(F.col("id") % 4 == 2, F.lower(F.base64(digest))).otherwise(F.base64(digest))
    made = docs.sparkSession.range(sample_strings).select(F.lit(True).alias("random"), forms.alias("token"))
    # Identifiers: three words in a row, joined in the usual ways.
    words = F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]{2,12}"), F.lit(0)), lambda w: w != "")
    at = lambda i, j: F.lower(F.get("w", i * 3 + j))
    mark = lambda i: F.get(F.array(F.lit("_"), F.lit("-"), F.lit("/")), i % 3)
    joined = lambda i: F.concat(at(i, 0), mark(i), at(i, 1), mark(i), at(i, 2))
    camel = lambda i: F.concat(at(i, 0), F.initcap(at(i, 1)), F.initcap(at(i, 2)), (i * 7 % 30).cast("string"))
    one = lambda i: F.when(i % 4 == 3, camel(i)).when(i % 8 == 1, F.upper(joined(i))).otherwise(joined(i))
    named = sample.select(F.slice(words, 1, 60).alias("w")).where("size(w) >= 3").select(F.lit(False).alias("random"), F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1), one)).alias("token"))
    # Numbers of all lengths are ordinary: of account, order and phone.
    digits = F.translate(F.sha2(F.concat(F.lit("number-"), F.col("id")), 256), "abcdef", "012345")
    numbers = docs.sparkSession.range(SAMPLE_NUMBERS).select(F.lit(False).alias("random"), F.substring(digits, F.lit(1), (F.col("id") % 33 + TRAIN_TOKEN).cast("int")).alias("token"))
    runs = docs.sparkSession.range(len(ALPHABET)).select(F.lit(False).alias("random"), F.repeat(F.substring(F.lit(ALPHABET), F.col("id").cast("int") + 1, F.lit(1)), 200).alias("token"))
    return secret.union(plain).union(named).union(numbers).union(made).union(runs)


def train(tokens: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of every pair of characters, by 67 * first + second (1-based places in ALPHABET)."""
    n = len(ALPHABET)
    pairs = tokens.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("random", "pair").count()  # at most 2 * 66 * 66 rows
    table = {True: [[smoothing] * n for _ in range(n)], False: [[smoothing] * n for _ in range(n)]}
    for r in counts.collect():
        if len(r["pair"]) == 2 and all(c in ALPHABET for c in r["pair"]):
            table[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["count"]
    ratios = [0.0] * ((n + 1) * (n + 1))
    for a in range(n):
        sums = {k: sum(t[a]) for k, t in table.items()}
        for b in range(n):
            ratios[(a + 1) * (n + 1) + b + 1] = math.log(table[True][a][b] / sums[True]) - math.log(table[False][a][b] / sums[False])
    return ratios


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the ratios over the token's pairs of characters; 0 for fewer than two."""
    width = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(f"{r:.4f}" for r in ratios)), ",").cast("array<double>")  # folded to a constant
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    scores = let(places, lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.coalesce(F.get(table, a * width + b), F.lit(0.0))))
    return F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)


def scan(docs: DataFrame, ratios: list[float], prior_log_odds: float = LOG_ODDS, least: int = LEAST_TOKEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, assign, access, hex and markov arrays of (start, end, value).

    Null and empty texts have no spans, very long ones are scanned whole. Markov spans never overlap a rule's span. Each row is scanned by
    itself, so repeated rows, null ids and clashing columns are of no account.
    """
    spans = docs.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    tokens = _outside(match_spans(F.coalesce("text", F.lit("")), TOKEN % least), F.col("base"))
    found = F.filter(tokens, lambda t: log_ratio(t["value"], ratios) > prior_log_odds)
    return spans.select("doc_id", "base.assign", "base.access", "base.hex", found.alias("markov"))


def _listed(kinds: tuple[str, ...]) -> Column:
    def rank(i: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))

    rows = [F.transform(k, rank(i)) for i, k in enumerate(kinds)]
    name = lambda i: F.element_at(F.array(*map(F.lit, KINDS)), i + 1)
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts, a digest of the rules' spans and the list of all spans, per document."""
    base, every = _listed(KINDS[:3]), _listed(KINDS)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), counts[3])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(scan(docs, train(labelled_tokens(docs))))
