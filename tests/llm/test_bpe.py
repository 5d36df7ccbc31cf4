"""BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe


@pytest.fixture(scope="module")
def lib():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def mine():
    return bpe.encoder(bpe.default_path())


def same(texts, lib, mine):
    import numpy as np

    ids = mine.encode_batch(texts)
    for t, raw, back in zip(texts, ids, mine.decode_batch(ids)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, dtype=np.int32).tolist() == want, repr(t[:80])
        assert back == lib.decode(want, skip_special_tokens=False)


def test_whole_table(spark, sf, lib):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op8_bpe(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = lib.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts(lib, mine):
    rng = random.Random(1)
    odd = ["", " ", "  a", "a  ", "\n\n\n", "\r\n x", "don't I'LL we've 'S", "x" * 500, "ab" * 5000, " " * 300, "\x00\x01\x7f", "１２３ Ⅷ ½", "日本語のテキスト", "  \u0085x", "\U0001f600\U0001f468‍\U0001f469",
           "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "é̀", "͸꟱", "ᲉꟋ"]
    alphabet = [chr(c) for c in (*range(32, 127), 0xE9, 0x4E00, 0x1F600, 0xA0, 0x3000, 0x200B, 0x0660)]
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    same(odd, lib, mine)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t):
    lib = Tokenizer.from_file(bpe.default_path()) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = lib
    same([t], lib, bpe.encoder(bpe.default_path()))


def test_speculation_is_verified(mine):
    """Words whose greedy tokens aren't the merges' result are merged exactly."""
    rng = random.Random(1)
    words = [w.encode() for w in {"".join(rng.choice("theandingtionres") for _ in range(9)) for _ in range(3000)}]
    got, exact = mine.vocab.encode_words(words)
    assert 0 < exact < len(words)
    for w, ids in zip(words, got):
        assert ids == mine.vocab.ids[mine.vocab.merge(w)].tobytes()


def test_odd_inputs(spark):
    df = spark.createDataFrame([(1, None, "k", 3), (2, "", "k", 3), (2, "", "k", 3), (None, "a b", "k", 3)], "doc_id long, text string, ids string, decoded int")
    got = [(r.doc_id, len(r.ids), r.decoded) for r in bpe.encode_decode(df).collect()]
    assert got == [(1, 0, ""), (2, 0, ""), (2, 0, ""), (None, 2, "a b")]
    assert bpe.encode_decode(df.limit(0)).collect() == []


def test_very_long_text(spark, lib):
    t = "lorem ipsum dolor " * 60_000 + "z" * 100_000
    r = bpe.encode_decode(spark.createDataFrame([(t,)], "text string")).collect()[0]
    assert r.ids == lib.encode(t, add_special_tokens=False).ids and r.decoded == t
