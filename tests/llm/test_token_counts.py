import base64
import random
import re

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from seqtrend.llm import token_counts as S

RANKS = P.path("byte_bpe_50k.tiktoken")


def plain():
    with open(RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def test_edits_against_full_encoding():
    rng, whole, counter = random.Random(2), plain(), S.Counter(RANKS, P.PATTERN)
    parts = ["  ", "\n\n", " the", "re", "'ll", "don't", " 12", "345", "...", " é", "😀", "\t", "x", " word", "-"]
    for n in [0, 1, 3, 40, 400, 1500] * 60:
        text = "".join(rng.choices(parts, k=n))
        tree = S.TokenTree.of(text, counter)
        assert tree.total == len(whole.encode_ordinary(text))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(1, 6)))
        edits = [(a, b, "".join(rng.choices(parts, k=rng.randint(0, 40)))) for a, b in zip(cuts[::2], cuts[1::2])]
        new, at = "", 0
        for a, b, r in edits:
            new, at = new + text[at:a] + r, b
        new += text[at:]
        tree.apply(edits)
        assert tree.total == len(whole.encode_ordinary(new)), (text, edits)
        assert tree.texts is None or "".join(tree.texts) == new


def test_against_plain_counts(spark, sf):
    whole = plain()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in S.op6(spark, sf).collect():
        assert r.n_tokens == len(whole.encode_ordinary(texts[r.doc_id]))
        masked, n = re.subn(S.MASKED, "<masked>", texts[r.doc_id])
        assert (r.n_edits, r.n_tokens_after) == (n, len(whole.encode_ordinary(masked)))
        assert r.leaves_encoded_again <= min(r.n_leaves, 4 * n)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = S.count_tokens(odd_docs.withColumn("edits", S.masks(F.col("text"))), RANKS, P.PATTERN).collect()
    assert len(rows) == odd_docs.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert S.count_tokens(no_docs.withColumn("edits", F.lit(None)), RANKS, P.PATTERN).count() == 0
    one = odd_docs.where("doc_id = 1").withColumn("edits", F.expr("array(struct(0 as start, 0 as end, 'two words' as replacement))"))
    assert S.count_tokens(one, RANKS, P.PATTERN).first().n_tokens_after == 2
