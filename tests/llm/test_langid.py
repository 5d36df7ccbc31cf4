"""Language ID: held-out accuracy, and the forward algorithm against all segmentations."""

from __future__ import annotations

import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import langid


def test_held_out_accuracy(spark, sf):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op10_langid(spark, sf).collect()
    assert len(got) == len(rows)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        letters = any(c.isalpha() for c in rows[r.doc_id].text or "")
        assert (r.lang_pred == langid.UNDETERMINED) == (not letters)
        if r.held_out and letters and rows[r.doc_id].lang:
            right.append(r.lang_pred == rows[r.doc_id].lang)
    assert np.mean(right) >= 0.95


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abc"]
    rng = np.random.default_rng(1)
    model = langid.Model(["x", "y"], {p: i for i, p in enumerate(pieces)}, rng.random((len(pieces), 2)), np.array([0.01, 0.02]))
    for word in ["a", "ab", "abc", "aabba", "zé", "abcabcab", "bz日a"]:
        w = "▁" + word
        total = np.zeros(2)
        for n in range(len(w)):
            for cuts in combinations(range(1, len(w)), n):
                at = [0, *cuts, len(w)]
                p = np.ones(2)
                for a, b in zip(at, at[1:]):
                    piece = w[a:b]
                    p = p * (model.prob[model.pieces[piece]] if piece in model.pieces else model.unknown if b - a == 1 else 0)
                total += p
        assert model.word_scores([word])[0] == pytest.approx(np.log(total))


def test_long_words_do_not_underflow_or_take_memory():
    model = langid.Model(["x", "y"], {"a": 0, "aa": 1}, np.array([[0.1, 0.2], [0.05, 0.01]]), np.array([1e-5, 1e-5]))
    got = model.text_scores(["a" * 20_000 + " " + " ".join("b" * k for k in range(1, 3000, 7)), "a"])
    assert all(np.isfinite(x).all() for x in got)


def test_fitting_takes_little_memory_and_blocks_do_not_matter(monkeypatch):
    """The driver fits: it holds a block of words times languages, not all of them."""
    rng = np.random.default_rng(2)
    found = sorted({"".join(rng.choice(list("abcdeé"), size=rng.integers(1, 14))) for _ in range(4000)}) + ["ab" * 500]
    counts = [(f"l{k:02}", w, int(c)) for w in found for k, c in enumerate(rng.integers(0, 3, size=40)) if c]
    pieces = ["▁", *"abcd", "▁a", "ab", "abc", "ba", "dd", "▁cd"]
    tracemalloc.start()
    model = langid.train(counts, pieces, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 62e6 with all words at once
    few = [c for c in counts if len(c[1]) < 4 or c[1] == found[-1]]
    usual = langid.train(few, pieces, rounds=2)
    for cells in (1, 40 * 1000, 1 << 40):
        monkeypatch.setattr(langid, "EM_CELLS", cells)
        other = langid.train(few, pieces, rounds=2)
        assert np.array_equal(other.prob, usual.prob) and np.array_equal(other.unknown, usual.unknown)
    assert np.allclose(model.prob.sum(axis=0) + 100 * model.unknown, 1)


def test_labels_and_sources_are_no_inputs(spark):
    docs = [(i, t, l) for i, (t, l) in enumerate([("the house and the garden of the man", "en"), ("das haus und der garten des mannes", "de")] * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df)
    a = langid.identify(df, model).select("doc_id", "lang_pred", "score").collect()
    b = langid.identify(df.selectExpr("doc_id", "text", "'zz' AS lang"), model).select("doc_id", "lang_pred", "score").collect()
    assert a == b and [r.lang_pred for r in a] == [d[2] for d in docs]


def test_odd_inputs(spark):
    df = spark.createDataFrame([(1, "hello there friend", "en", "q"), (1, "hello there friend", "en", "q"), (2, None, "en", "q"), (3, "", None, "q"), (4, "123 !?", "fr", "q"), (None, "bonjour mon ami", "fr", "q")], "doc_id long, text string, lang string, score string")
    got = langid.identify(df, langid.fit(df)).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "fr")]
    assert all(0 <= r.score <= 1 for r in got)
    none = df.limit(0)
    nothing = langid.fit(none)
    assert langid.identify(none, nothing).collect() == []
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}


def test_letters_are_letters_on_both_sides(spark):
    """Numerals that aren't letters have no language, in learning or in prediction."""
    df = spark.createDataFrame([(1, "the house ½ ² ③ Ⅷ", "en"), (2, "½ ² ③", "es"), (3, "Ⅷ", "es"), (4, "١٢٣ ㊀", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["en"]
    assert [(r.lang_pred, r.score) for r in langid.identify(df, model).collect()] == [("en", 1.0)] + [("und", 0.0)] * 3


def test_a_language_of_long_texts_and_long_words_is_learned(spark):
    rows = [(i, f"the house and the garden {i} of the man", "en") for i in range(9)] + [(50, "casa y jardin de la mujer " * 6000, "la"), (51, "zz" * 40_000 + " qqqxq", "lz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == ["en", "la", "lz"]
    assert [r.lang_pred for r in langid.identify(df, model).collect()] == [r[2] for r in rows]


def _brute_force(docs: list[tuple], pieces: list[str]) -> dict[int, tuple[str, float]]:
    """The whole query in plain sums over segmentations: EM on the learning rows, posteriors of all rows."""
    import math
    import unicodedata

    def words(text):
        marked = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
        return marked.split(" ") if marked.strip() else []

    known, v = set(pieces), len(pieces)
    kept = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    langs = sorted({lang for i, t, lang in docs if kept(i) and t is not None and lang is not None and any(words(t))})
    learned = {lang: [w for t in {t for i, t, x in docs if kept(i) and x == lang and t is not None} for w in words(t) if w] for lang in langs}

    def chart(word, prob):
        w = "▁" + word
        edges = [(i, j, w[i:j] if w[i:j] in known else None) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if w[i:j] in known or j == i + 1]
        f, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        for i, j, p in edges:
            f[j] += f[i] * prob[p]
        for i, j, p in reversed(edges):
            b[i] += b[j] * prob[p]
        return edges, f, b

    probs = {}
    for lang in langs:
        prob = {p: 1 / (v + 1) for p in pieces} | {None: 1 / (v + 1) / 1000}
        for _ in range(langid.EM_ROUNDS):
            total = {p: 0.05 for p in [*pieces, None]}
            for word in learned[lang]:
                edges, f, b = chart(word, prob)
                for i, j, p in edges:
                    total[p] += f[i] * prob[p] * b[j] / f[-1]
            mass = sum(total.values())
            prob = {p: x / mass for p, x in total.items()}
            prob[None] /= 100
        probs[lang] = prob
    out = {}
    for i, t, _ in docs:
        found = [w for w in words(t) if w]
        if not found or not langs:
            out[i] = ("und", 0.0)
            continue
        s = {lang: sum(math.log(chart(w, probs[lang])[1][-1]) for w in found) for lang in langs}
        best = max(langs, key=lambda x: (s[x], [-ord(c) for c in x]))
        out[i] = (best, 1 / sum(math.exp(s[x] - s[best]) for x in langs))
    return out


def test_whole_query_against_brute_force(spark, tmp_path):
    from pyspark.sql import functions as F

    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 400).select("doc_id", "text", "lang").collect()
    docs = [(r.doc_id, r.text, r.lang) for r in src][:60] + [(9001, "½ Ⅷ 12", "en"), (9002, None, "fr"), (9003, "ΑΩ 日本 words", None), (9004, "", "de"), (9005, docs_text := src[0].text, src[0].lang), (9006, docs_text, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = _brute_force(docs, langid.load_pieces(langid.default_path()))
    got = langid.op10_langid(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.lang_pred, pytest.approx(r.score, abs=1e-6)) for r in got} == want
