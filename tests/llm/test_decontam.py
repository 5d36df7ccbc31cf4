"""Decontamination against a search for every window."""

from __future__ import annotations

import hashlib
import random
import re

from millrace.llm import decontam

_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(t):
    return _WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute_force(docs, items, window=10):
    out = set()
    by = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            by.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in by}
    for i, t in docs:
        w = words(t)
        hit, who = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := by.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [1] * n
                    who |= ids
        out.add((i, len(w), sum(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), sum(hit) > 0))
    return out


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {tuple(r) for r in decontam.op9_decontam(spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == brute_force(docs, items) and any(g[5] for g in got)


def _made():
    rng = random.Random(2)
    vocab = ["a", "b", "C", "é", "9", "xy", "日"]
    text = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([1, 2, 3, 9, 10, 11, 14, 30, 0])] + [(3, "repeated id text b b b"), (None, "null id here"), (50, None), (51, "!!!"), (52, None)]
    docs = [(k, text(rng.randint(0, 80))) for k in range(200)] + [(500, None), (501, ""), (502, items[7][1] + " " + items[6][1]), (503, items[7][1])]
    return docs, items


def _run(spark, docs, items, **k):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return decontam.decontaminate(d, i, **k)


def test_made_texts(spark):
    docs, items = _made()
    got = {(r.doc_id, r.n_words, r.n_hit, len(r.hit_items), hashlib.sha256(",".join(r.hit_items).encode()).hexdigest(), r.n_hit > 0) for r in _run(spark, docs, items).collect()}
    assert got == brute_force(docs, items)


def test_several_automata(spark):
    docs, items = _made()
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, r.hit_words, r.hit_spans, r.hit_items)
    one = sorted(map(key, _run(spark, docs, items).collect()))
    assert sorted(map(key, _run(spark, docs, items, max_automaton_bytes=40).collect())) == one


def test_offsets_are_of_the_original(spark):
    item = [(1, "The quick brown fox jumps over the lazy dog today")]
    doc = [(1, "¡Hola! \U0001f600 THE   quick, brown-fox jumps over the lazy dog TODAY. End")]
    r = _run(spark, doc, item).collect()[0]
    (s,) = r.hit_spans
    assert doc[0][1][s.start : s.end] == "THE   quick, brown-fox jumps over the lazy dog TODAY"
    assert [(w.start, w.end) for w in r.hit_words] == [(2, 12)]


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(None, "x y", 1), (2, None, 2)], "doc_id long, text string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.hit_items) for r in decontam.decontaminate(docs, none).collect()] == [(2, 0, []), (0, 0, [])]
    assert decontam.decontaminate(docs.limit(0), none).collect() == []
    long = "word " * 500_000 + "the needle is in here somewhere deep down at last end"
    big = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = decontam.decontaminate(big, spark.createDataFrame([(1, "the needle is in here somewhere deep down at last")], "item_id long, text string")).collect()[0]
    assert (r.n_words, r.n_hit) == (500_011, 10)


def test_an_automaton_takes_no_more_than_estimated():
    """In a process of its own: what building a shard's automaton adds to its memory."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import random, sys
sys.path.insert(0, sys.argv[1])
from millrace.llm import decontam
r = random.Random(3)
word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
vocab = [word() for _ in range(20000)]
items = [(str(i), " ".join(r.choice(vocab) if i % 2 else word() for _ in range(400))) for i in range(125)]
rss = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1]) * 1024
before = rss()
kept = decontam.build(items, 10)
print(rss() - before, sum(decontam.weight(t, 10) for _, t in items))
"""
    grown, most = map(int, subprocess.run([sys.executable, "-c", code, str(Path(decontam.__file__).parents[2])], capture_output=True, text=True, check=True).stdout.split())
    assert most / 5 < grown < most
