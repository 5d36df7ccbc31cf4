"""Exact repeats against a count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import suffix


def brute_force(rows: list[tuple[int, str | None]], length: int) -> set[tuple]:
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = set()
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for p in range(len(r)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.add((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(spark, rows, length) -> set[tuple]:
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = suffix.remove_repeats(df, length=length)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    out = out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))), gone, F.size("spans"), F.sha2("kept", 256))
    return {tuple(r) for r in out.collect()}


def _random(rng, n, alphabet="abcdefgh ö€"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def _corpus(seed: int, length: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    shared = [_random(rng, length + k) for k in (0, 1, 37, 300)]
    texts: list[str | None] = [None, "", "a", "x" * (length - 1), "x" * length, "x" * (length + 5), "ab" * length, _random(rng, length)]
    for k in range(40):
        parts = [_random(rng, rng.randint(0, 2 * length))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 3)
            parts += [s[cut:], _random(rng, rng.randint(0, length))]
        texts.append("".join(parts))
    texts += [texts[10], texts[11], texts[11]]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "length"), [(1, 64), (2, 100), (3, 400)])
def test_against_all_windows(spark, seed, length):
    rows = _corpus(seed, length)
    assert result(spark, rows, length) == brute_force(rows, length)


def test_large_buckets(spark, monkeypatch):
    """Buckets beyond what one task refines go by an aggregate: the same result."""
    monkeypatch.setattr(suffix, "TASK_RUNS", 3)
    rows = _corpus(4, 100)
    assert result(spark, rows, 100) == brute_force(rows, 100)


def test_contract_query(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    got = {tuple(r) for r in suffix.op5_suffix(spark, sf_small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == brute_force(rows, 400)


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(empty).collect() == []
    rng = random.Random(5)
    long = "".join(rng.choice("abc ") for _ in range(400_000))
    rows = [(1, long, 1, "k"), (None, long[1000:2000], 2, "k"), (None, None, 3, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int, key string")
    got = {r.doc_id: r for r in suffix.remove_repeats(df).collect() if r.doc_id}
    assert [(s.start, s.end) for s in got[1].spans] == [(1000, 2000)]
    assert bytes(got[1].kept).decode() == long[:1000] + long[2000:]
    assert set(got[1].asDict()) == {"doc_id", "text", "key", "spans", "kept"}


def test_periodic_text(spark):
    rows = [(1, "a" * 5000), (2, "b" * 450 + "c" * 100 + "b" * 450), (3, "xyz" * 500)]
    assert result(spark, rows, 400) == brute_force(rows, 400)
