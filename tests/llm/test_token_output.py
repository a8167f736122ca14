import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqtrend.llm import token_output as S

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24, 31])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 4095, 4096, 4097, 10_000):
        ids = rng.integers(0, 1 << bits, n).astype("<u4")
        held = S.Segment(S.segment([None, 5], [n // 3, n - n // 3], ids, bits))
        assert held.doc_ids == [None, 5] and (held.ids(0, n) == ids).all()
        assert (held.document(1) == ids[n // 3 :]).all() and (held.ids(n // 2, n) == ids[n // 2 :]).all()
        assert len(held.packed) <= n * bits // 8 + 1


def test_against_plain_encoding(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in S.op1(spark, sf).collect()) == brute(rows)


def test_words_are_independent():
    text = "A̸ b ̸c <|endoftext|>x <|endof text|> \x1c \x85  it's 'S ΣΑΣ Σ ΟΔΥΣ İx 😀ab‍ ﬀ 12a3 \x00 é é don't''ll"
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(S.encoder(PATH)(text), "<u4").tolist() == ids
    S._tokenizer(PATH)[1].clear()
    assert np.frombuffer(S.encoder(PATH)(text + "\n" + text), "<u4").tolist() == ids + ids


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    S.write_tokens(odd_docs, f"file://{tmp_path}/a", PATH)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = S.read_tokens(spark, f"file://{tmp_path}/a").collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), n, c) for d, _, n, c in want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered])[:-1])
    assert [r.doc_id for r in ordered] == [d for d, *_ in want]
    S.write_tokens(no_docs, f"file://{tmp_path}/b", PATH)
    assert S.read_tokens(spark, f"file://{tmp_path}/b").count() == 0
