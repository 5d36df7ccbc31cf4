"""The language model: exact counts and base, exact normalisation, better than the base on held-out texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lm

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t: str | None) -> list[str | None]:
    return [*_WORD.findall("".join(c.lower() if c.isascii() else c for c in t or "")), None]


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def expected(rows):
    counts = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = tokens(t)
        out[i] = (held_out(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    return out


def check(got, rows):
    want = expected(rows)
    assert len(got) == len(rows)
    for r in got:
        h, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score <= 0 and math.isfinite(r.score)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op2_lm(spark, sf).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    # on texts it hasn't seen, the model must be well above the unigram base, token by token
    n = sum(r.n_tokens for r in held)
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / n
    assert gain >= 0.15, gain


def _fitted(spark, texts):
    return lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"))


def _brute_force(text, model, count):
    """Log10 probability of a text, token by token, with plain sums over all groups and members."""
    p, own = model.params, {int(h): k for k, h in enumerate(model.own)}
    before, total = [], 0.0
    for h, shared in [(int(h), int(s)) for hs, ss, _ in lm._tokens([text or ""]) for h, s in zip(hs, ss)]:
        rank = own.get(h, lm.OWN + shared)
        c = int(model.number[rank])
        ctx = [sum(float(p.scale[k, d]) * float(p.r[x, d]) for k, x in enumerate(before[::-1][: lm.CONTEXT])) for d in range(lm.DIM)]
        level = lambda q, b: [math.exp(sum(a * float(y) for a, y in zip(ctx, qq)) + float(bb)) for qq, bb in zip(q, b)]
        g = c // lm.MEMBERS
        groups, members = level(p.qg, p.bg), level(p.q[g * lm.MEMBERS : (g + 1) * lm.MEMBERS], p.b[g * lm.MEMBERS : (g + 1) * lm.MEMBERS])
        prob = groups[g] / sum(groups) * members[c % lm.MEMBERS] / sum(members)
        if rank >= lm.OWN:
            prob *= (count.get(h, 0) + 1) / model.class_sums[shared]
        total += math.log10(prob)
        before.append(c)
    return total


def test_scores_against_brute_force(spark):
    texts = [" ".join(f"w{(i * 120 + j) % 4900}" for j in range(120)) for i in range(60)]
    model, counts = _fitted(spark, texts)
    count = {int(np.int64(r.h).view(np.uint64)): r.c for r in counts.collect()}
    assert len(count) > lm.OWN  # some words share classes
    rows = list(enumerate([texts[0], texts[41][:200], None, "", "new words w1 W2 w3 and w4899"]))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), model, counts).collect()}
    for i, t in rows:
        assert got[i].score == pytest.approx(_brute_force(t, model, count), rel=1e-4)


def test_normalised(spark):
    """In each context all classes sum to 1, and so do the words of a shared class and one unseen word."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 4900}" for j in range(200)) for i in range(40)]
    model, counts = _fitted(spark, texts)
    every = np.arange(lm.CLASSES)
    for before in ([], [3], [5, 7, 9]):
        logs = [model.params.log_probs(np.array([*before, c]), np.arange(len(before) + 1))[-1] for c in every]
        assert np.exp(logs).sum() == pytest.approx(1, rel=1e-4)
    own, shares = {int(h) for h in model.own.view(np.int64)}, 1 / model.class_sums
    for r in counts.collect():
        if r.h not in own:
            shares[r.shared] += (r.c + 1) / model.class_sums[r.shared]
    assert shares == pytest.approx(np.ones(lm.SHARED))


def test_the_model_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1500)
    df = spark.createDataFrame([(" ".join(f"w{(i * 7 + j * j) % 900}" for j in range(200)),) for i in range(40)], "text string")
    a, b = (lm.fit(df.repartition(n))[0].params.flat() for n in (1, 7))
    assert np.allclose(a, b, atol=1e-6) and not np.allclose(a, lm.Params.start(lm.fit(df)[0].unigram).flat(), atol=1e-3)


def test_rare_words_are_joined(spark, monkeypatch):
    """With few broadcast words the counts of the others come by the join: the same figures."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 900}" for j in range(200)) for i in range(30)] + [None, "", "never seen words"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = df.where(~lm.held_out()).select("text")
    full = {r.doc_id: r for r in lm.score(df, *lm.fit(train)).collect()}
    monkeypatch.setattr(lm, "HEAD", 20)
    few = {r.doc_id: r for r in lm.score(df, *lm.fit(train)).collect()}
    want = expected(rows)
    for i in full:
        assert few[i].n_known == full[i].n_known == want[i][2]
        assert few[i].base_score == pytest.approx(want[i][4], rel=1e-9)
        assert full[i].base_score == pytest.approx(want[i][4], rel=1e-9)


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model, counts = lm.fit(none.select("text"))
    assert lm.score(none, model, counts).collect() == []
    odd = spark.createDataFrame([(1, None, 5.0, 2), (1, None, 5.0, 2), (None, "a b", 1.0, 3), (2, "x" * 500_000, 0.0, 0)], "doc_id long, text string, score double, rid long")
    got = sorted(lm.score(odd, model, counts).collect(), key=lambda r: r.n_tokens)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.rid) for r in got] == [(1, 0, 0, 2), (1, 0, 0, 2), (2, 0, 0, 0), (3, 0, 0, 3)]
    assert got[0].base_score == pytest.approx(0)


def test_gradient_matches_differences():
    """The estimate's gradient against finite differences, for one step with fixed noise."""
    unigram = np.full(lm.CLASSES, 1 / lm.CLASSES)
    start = lm.Params.start(unigram)
    t = lm.Trainer(start, unigram, 1)
    w, place = np.array([3, 70, 3, 200, 5]), np.array([0, 1, 2, 0, 1])
    groups, drawn = lm.Trainer(start, unigram, 1).noise()
    members = {g: g * lm.MEMBERS + drawn[g] for g in {*(w // lm.MEMBERS).tolist()}}

    def likelihood(x):
        p, total = lm.Params.of(x), 0.0
        ctx = p.context(w, place)[0].astype(np.float64)
        say = lambda z, true: -np.log1p(np.exp(-z if true else z))
        for i, c in enumerate(w):
            g = c // lm.MEMBERS
            shift = np.log(lm.NOISE_GROUPS / lm.GROUPS)
            total += say(ctx[i] @ p.qg[g] + p.bg[g] - shift, True) + sum(say(ctx[i] @ p.qg[k] + p.bg[k] - shift, False) for k in groups)
            shift = np.log(lm.NOISE_MEMBERS / lm.MEMBERS)
            total += say(ctx[i] @ p.q[c] + p.b[c] - shift, True) + sum(say(ctx[i] @ p.q[k] + p.b[k] - shift, False) for k in members[g])
        return total

    before = start.flat().astype(np.float64)
    t.step(w, place)
    moved = t.p.flat() - before
    assert likelihood(t.p.flat()) > likelihood(before)
    found = np.flatnonzero(np.abs(moved) > 1e-4)
    assert len(found) > 100
    for k in found[::37]:
        e = np.zeros_like(before)
        e[k] = 1e-2
        slope = (likelihood(before + e) - likelihood(before - e)) / 2e-2
        assert slope * moved[k] > 0
