"""MinHash near-dedup against all pairs of full sets."""

from __future__ import annotations

import random
import re

import pytest

from millrace.llm import minhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = _WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_force(rows: list[tuple[int, str | None]], num: int = 85, den: int = 100) -> set[tuple]:
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (a, sa) in enumerate(sets):
        for b, sb in sets[k + 1 :]:
            if sa and sb and den * len(sa & sb) >= num * len(sa | sb):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {(i, len(s), top(i), top(i) == i) for i, s in sets}


def result(df) -> set[tuple]:
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def corpus(seed: int, words: int, families: int, members: int, edits: int) -> list[str]:
    """Families of texts that drift away from their first one, a few words at a time."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocab) for _ in range(words)]
        for _ in range(members):
            out.append(" ".join(base))
            for _ in range(rng.randint(0, edits)):
                base[rng.randrange(words)] = rng.choice(vocab)
    return out


def test_against_all_pairs(spark):
    texts = corpus(1, 120, 6, 12, 4) + corpus(2, 25, 10, 5, 1) + ["one two", "ONE  two", "one", "", None, " \t\n", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(minhash.near_duplicates(df, num=85)) == brute_force(rows)
    assert result(minhash.near_duplicates(df)) == brute_force(rows, 80)


def test_long_lists_go_by_hubs_and_blocks(spark, monkeypatch):
    """A large family of near copies, most of them unlike its hub: nothing is lost."""
    monkeypatch.setattr(minhash, "LIST", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = list(enumerate(corpus(4, 60, 2, 70, 2)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(minhash.near_duplicates(df, num=85)) == brute_force(rows)


def test_a_hub_of_dissimilar_members(spark, monkeypatch):
    """Members of one long list that are like none: their sketches settle it and no text is dealt to blocks."""
    monkeypatch.setattr(minhash, "NODE_PAIRS", 100)
    rng = random.Random(9)
    base = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*(f"o{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 60) if i % 10 else 4)), *base])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(minhash.near_duplicates(df, num=85)) == brute_force(rows)


def test_groups_of_copies(spark):
    texts = corpus(5, 80, 1, 1, 0) * 300 + corpus(6, 80, 1, 40, 1)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(minhash.near_duplicates(df, num=85)) == brute_force(rows)


def test_whole_table_against_all_pairs(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert result(minhash.op1_near_dedup(spark, sf_small).select("doc_id", "n_shingles", "component_id", "kept")) == brute_force(rows)


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).collect() == []
    t = "a b c d e f g h"
    rows = [(1, t), (1, t), (None, t), (None, "alone among the others here"), (None, None), (7, t.upper())]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, node long, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 4, 1, True), (1, 4, 1, True), (None, 4, 1, False), (7, 4, 1, False), (None, 1, None, True), (None, 0, None, True)], key=str)


def test_very_long_text(spark):
    rng = random.Random(8)
    words = [f"v{rng.randrange(5000)}" for _ in range(300_000)]
    other = list(words)
    for i in range(0, len(other), 100):
        other[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(df)) == brute_force(rows, 80)


@pytest.mark.parametrize("t", [0.8, 0.85])
def test_prefixes_miss_nothing_that_shares_enough(t):
    for n in range(1, 60):
        assert 1 <= minhash.prefix_for(n, t) <= min(n, minhash.K)
