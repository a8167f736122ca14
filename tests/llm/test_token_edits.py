import random

import public_tokenizers as P
from pyspark.sql import functions as F

from seqtrend.llm import token_counts as S


def mutate(rng, text):
    """Up to four edits, ascending and disjoint, and the text after them."""
    pieces = ["", " ", "\n", "   ", "12", "9", "word", " new words here", "'s", "\n\n  ", "x" * 40, "é😀", "3.14 apples\n", " a b c " * 40]
    places = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(1, 4))))
    edits, out, at = [], [], 0
    for a, b in zip(places[::2], places[1::2]):
        b = min(b, a + rng.choice((0, 1, 5, 60, 900)))
        edits.append((a, b, rng.choice(pieces)))
        out += [text[at:a], edits[-1][2]]
        at = b
    return edits, "".join([*out, text[at:]])


def test_sequences_of_edits(spark):
    rng = random.Random(3)
    counter = S.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    words = ["the", "and", "12345", "it's", "house", "\n", "\n\n", "  ", "tree,", "(x)", "Über", "😀", "a", "1"]
    fresh = lambda t: sum(map(counter, counter.pattern.findall(t)))
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice((" ", " ", " ", "", "\n", "   ")) for _ in range(rng.choice((0, 3, 60, 700))))
        tree = S.TokenTree.of(text, counter)
        for _ in range(4):
            edits, text = mutate(rng, text)
            tree.apply(edits)
            assert "".join(tree.texts) == text and tree.total == fresh(text)
            texts, counts = tree.leaves()
            assert sum(counts) == tree.total and all(n == fresh(t) or len(t) < 2000 for t, n in zip(texts, counts))
            assert all(len(counter.pattern.findall(t)) <= 2 * S.LEAF for t in texts)
            if rng.random() < 0.3:
                tree = S.TokenTree(counter, *tree.leaves())
    text = "some words of a long text " * 2000
    tree = S.TokenTree.of(text, counter)
    tree.apply([(26000, 26004, "other")])
    assert tree.encoded <= 6 < len(tree.texts) // 50 and tree.total == fresh(text[:26000] + "other" + text[26004:])


def test_stored_trees_take_edits_twice(spark, odd_docs):
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    counter = S.Counter(*args)
    docs = spark.createDataFrame([(1, "call 123456 or mail a@b.cd now " * 50), (2, None), (None, "")], "doc_id long, text string")
    trees = S.token_trees(docs.withColumn("edits", S.masks(F.col("text"))), *args)
    once = S.apply_edits(trees, *args)
    again = S.apply_edits(once.withColumn("edits", F.expr("array(struct(0 as start, 0 as end, 'Please ' as replacement))")), *args)
    got = {r.doc_id: r for r in again.collect()}
    want = "Please " + "call <masked> or mail <masked> now " * 50
    assert "".join(got[1].leaves) == want and got[1].n_tokens_after == sum(map(counter, counter.pattern.findall(want)))
    assert got[2].n_tokens == 0 and "".join(got[2].leaves) == "".join(got[None].leaves) == "Please "
    assert S.token_trees(odd_docs, *args).count() == odd_docs.count()
