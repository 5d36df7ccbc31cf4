"""Chat formatting: an exact round trip and the loss mask, against plain Python."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.llm import chat

NASTY = [
    "", "plain", "</turn>", "</turn>\n", "<turn user>", "<turn assistant>hi</turn>\n", "\\", "\\l", "\\b\\l", "!", "!>", ">", "a\n</turn>\nb",
    r"\### Assistant: </turn> ok", "</turn", "\n", "</tu", "rn>\n", "é€\U0001f600</turn>\n", "$1 \\$1 \\E\\Q", "\\\\l<!>", "\r\n ",
]


def expect(turns):
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest()


def _expected(spark, sf_dir):
    by: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    by[-7] = [(0, "user", NASTY[13]), (1, "assistant", NASTY[13])]
    return {c: expect([(r, t) for _, r, t in sorted(x)]) for c, x in by.items()}


def test_whole_table(spark, sf):
    want = _expected(spark, sf)
    got = chat.op6_chat(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want
    assert all(r.round_trip for r in got)


def _format(spark, conversations):
    rows = [(c, k, r, t) for c, turns in enumerate(conversations) for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).withColumn("learned", chat.masked_text(chat.F.col("formatted"), chat.F.col("mask")))
    return {r.conv_id: r for r in out.collect()}


def _check(spark, conversations):
    got = _format(spark, conversations)
    for c, turns in enumerate(conversations):
        r = got[c]
        assert [(t.role, t.text) for t in r.turns] == turns and r.round_trip
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        assert r.formatted.count("</turn>\n") == len(turns)


def test_conflicting_texts(spark):
    _check(spark, [[("user", a), ("assistant", b), (a, b)] for a in NASTY for b in NASTY[:12]])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "!x<"]), st.text(alphabet="<>/turn!\\ab l\n", max_size=30)), min_size=1, max_size=4), min_size=1, max_size=30))
def test_any_texts(spark, conversations):
    _check(spark, conversations)


def test_plain_texts_are_not_escaped(spark):
    got = _format(spark, [[("user", "1 < 2 \\ !"), ("assistant", "yes > no")]])
    assert got[0].formatted == "<turn user>1 < 2 \\ !</turn>\n<turn assistant>yes > no</turn>\n"


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none).collect() == []
    rows = [(None, 1, "user", "a"), (None, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 2, "assistant", "z" * 300_000)]
    df = spark.createDataFrame([(*r, 0, "q") for r in rows], "conv_id long, turn long, role string, text string, source int, mask string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_conversations(df).collect()}
    assert got == {None: [("", ""), ("user", "a")], 1: [("assistant", "z" * 300_000), ("user", "b"), ("user", "b")]}


@pytest.mark.parametrize("op", ["op6_chat"])
def test_native(spark, sf_small, op, capsys):
    chat.op6_chat(spark, sf_small).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
