"""Secret scans against plain searches with the contract's expressions."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from millrace.llm import secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)


def base(t: str | None) -> list[tuple[int, int, int]]:
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found)


def digest(found) -> str:
    return hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found).encode()).hexdigest()


def test_whole_table(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = secrets.op7_secrets(spark, sf).collect()
    assert len(got) == len(rows) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        want = base(rows[r.doc_id])
        assert r.base_sha256 == digest(want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        mine = [x for x in r.spans.split(",") if x]
        assert {f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want} <= set(mine)


def test_scanner_finds_what_a_search_finds():
    """On made-up texts near the rules' borders, the index gives up no match."""
    rng = random.Random(1)
    bits = ["password", "PassWord", "api_key", "apikey", "=", ":", " ", '"', "'", "abcd1234", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "K", "tok", "en", "ghp_", "A" * 36,
            "xoxb-", "eyJhbGciOiJI.", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "AIza", "sk_live_", "Bearer ", "\xff\xff", "\n", "ſ" + "ecret"]
    block = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", "a"]
    got = secrets.Scanner(secrets.RULES).scan(block)
    for t, found in zip(block, got):
        want = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t) if m.end(r.group) - m.start(r.group) >= r.least]
        assert found == sorted(want)
        assert [x for x in found if x[1] < 3] == base(t)


@pytest.mark.parametrize(("pattern", "query"), [
    ("abc", ("gram", "abc")), ("abcd", ("and", ("gram", "abc"), ("gram", "bcd"))), ("(abc|xyz)", ("or", ("gram", "abc"), ("gram", "xyz"))),
    ("ab+", None), ("[0-9]{5}", None), ("(abc)?", None), ("(abc)+x*", ("gram", "abc")), ("a.c", None), ("ABC", ("gram", "abc")),
])
def test_queries(pattern, query):
    assert secrets.trigram_query(pattern) == query


def test_rules_without_trigrams_scan_fully():
    rules = (secrets.Rule("digits", "[0-9]{4}"), secrets.Rule("word", "needle"))
    assert secrets.trigram_query(rules[0].pattern) is None
    assert secrets.Scanner(rules).scan(["1234", "a needle", ""]) == [[(0, 0, 4)], [(2, 1, 8)], []]


def test_odd_inputs_and_redaction(spark):
    rows = [(1, None), (2, ""), (3, "say password=abcdefgh12 twice password=abcdefgh12"), (3, "\U0001f600 AKIA" + "A" * 12), (None, "token: 0123456789abcdef0123456789abcdef!")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, secrets int, kind string")
    out = secrets.redact(secrets.find_secrets(df))
    got = [(r.doc_id, r.text, len(r.secrets), r.kind) for r in out.collect()]
    assert got == [(1, None, 0, "x"), (2, "", 0, "x"), (3, "say <SECRET> twice <SECRET>", 2, "x"), (3, "\U0001f600 <SECRET>", 1, "x"), (None, "<SECRET>!", 2, "x")]
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_very_long_text(spark):
    t = "x" * 2_000_000 + " secret=" + "a" * 40 + " " + "y" * 1000
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    found = secrets.find_secrets(df).collect()[0].secrets
    assert [(f.start, f.end) for f in found if f.kind == "assign"] == [(m.start(), m.end()) for m in ASSIGN.finditer(t)]
