import base64
import random

from seqtrend.llm import secrets as S


def strings(seed, n):
    """Random strings that no rule has, and ordinary identifiers, both of 16 characters or more."""
    rng = random.Random(seed)
    syllables = ["ta", "ren", "mo", "li", "sor", "ka", "ver", "in", "do", "pel", "an", "ris", "te", "nu", "gal", "er", "ion", "ment", "pro", "con"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    hidden, plain = [], []
    while len(hidden) < n:
        raw = rng.randbytes(rng.randint(14, 30))
        token = rng.choice((base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("="), base64.b32encode(raw).decode().rstrip("="), "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(18, 40)))))
        hidden.append(token)
    while len(plain) < n:
        parts = [word() for _ in range(rng.randint(3, 6))]
        token = rng.choice(("_".join(parts), "-".join(parts), "/".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "_".join(parts).upper(), "".join(parts), f"{'_'.join(parts)}_{rng.randint(1, 2030)}"))
        if len(token) >= S.LEAST_TOKEN:
            plain.append(token)
    return hidden, plain


def test_planted_strings_without_a_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = S.train(S.labelled_tokens(docs))
    hidden, plain = strings(9, 1000)
    planted = spark.createDataFrame([(i, f"see {h} and then {p} here") for i, (h, p) in enumerate(zip(hidden, plain))], "doc_id long, text string")
    rows = S.scan(planted, model).selectExpr("doc_id", "transform(markov, s -> s.value) AS found", "size(assign) + size(access) + size(hex) AS by_rule").collect()
    caught = sum(hidden[r.doc_id] in r.found for r in rows)
    wrong = sum(plain[r.doc_id] in r.found for r in rows)
    ruled = sum(r.by_rule for r in rows)
    print("recall", caught / (1000 - ruled), "precision", caught / (caught + wrong))
    assert caught >= 0.95 * (1000 - ruled) and wrong <= 0.05 * caught
    whole = S.digests(S.scan(docs, model)).agg({"n_markov": "sum"}).first()[0]
    assert whole == 0  # the given documents hide nothing that no rule has
    # Numbers of all lengths, also in groups.
    rng = random.Random(4)
    digits = ["".join(rng.choices("0123456789", k=k)) for k in range(16, 60) for _ in range(5)] + [f"{rng.randrange(10**9)}-{rng.randrange(10**12)}" for _ in range(100)]
    numbers = spark.createDataFrame([(i, f"order {x} of") for i, x in enumerate(digits)], "doc_id long, text string")
    found = S.scan(numbers, model).selectExpr("size(markov) AS n").agg({"n": "sum"}).first()[0]
    assert found <= 0.02 * len(digits)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(None, "the same row of some words")] * 400 + [(5, f"row number{i} of many") for i in range(100)], "doc_id long, text string")
    for n in (10, 450):
        plain = S.labelled_tokens(docs, sample_docs=n, sample_strings=4).where("not random and length(token) < 100 and token not rlike '^[0-9]+$'").count()
        assert 0 < plain <= 3 * n
