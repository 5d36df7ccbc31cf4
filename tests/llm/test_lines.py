"""Line dedup against its SQL, and on cases made for it."""

from __future__ import annotations

import pandas as pd

from millrace.llm import lines


def _fixture() -> pd.DataFrame:
    rows, words = [], ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    for i in range(40):
        own = [" ".join(words[(i + j * k) % 8] + "x" * ((i * j) % 5) for k in range(3 + (i * 3 + j) % 9)) + f" tail{i}" for j in range(6)]
        own.insert(i % 5, f"Printed on page {i} of {i * 3} by the press")
        own.insert((i * 2) % 6, f"Contact the office of region{chr(97 + i % 26)} for further help today please")
        if i % 4 == 0:
            own.insert(2, "All rights are reserved by us")
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, rows[0][1]), (105, "Printed on page 7 of 9 by the press"), (None, "short line\tof   words\r\nx"), (100, None)]
    return pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})


def _rows(frame: pd.DataFrame) -> list[tuple]:
    cols = frame[["doc_id", "n_lines", "n_dropped", "kept_sha256"]].itertuples(index=False)
    return sorted((str(None if pd.isna(a) else int(a)), int(b), int(c), d) for a, b, c, d in cols)


def _query(df) -> pd.DataFrame:
    from pyspark.sql import functions as F

    return lines.line_dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")).toPandas()


def test_sql_on_fixture(spark, duck, sf_small):
    f = _fixture()
    df = spark.createDataFrame([(None if pd.isna(a) else int(a), b) for a, b in f.itertuples(index=False)], "doc_id long, text string").repartition(3)
    assert _rows(_query(df)) == _rows(duck(lines.oracle(), sf_small, {"documents": f}))


def test_sql_on_whole_table(spark, duck, sf):
    assert _rows(lines.op4_line_dedup(spark, sf).toPandas()) == _rows(duck(lines.oracle(), sf))


def test_recurring_templates_go_and_others_stay(spark):
    f = _fixture()
    df = spark.createDataFrame([(None if pd.isna(a) else int(a), b) for a, b in f.itertuples(index=False)], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.line_dedup(df).where("doc_id < 40").collect()}
    for i, r in got.items():
        assert "Printed on page" not in r.text  # the digits vary
        assert "Contact the office" not in r.text  # a word varies
        assert r.text.count(f"tail{i}") == 6  # own lines stay


def _words(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlucmfw") for _ in range(r.randint(2, 9))) for _ in range(n))


def _left(spark, rows: list[str]) -> list:
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)
    return [r for r in sorted(lines.line_dedup(df).collect(), key=lambda r: r.doc_id)]


def test_fixed_blocks_go(spark):
    """A banner of two lines and a footer that is always last; each document has another text in between."""
    banner, footer = ["All rights reserved by the owner", "Use of this file needs written consent"], "Printed in the north of the country"
    own = [[_words(7 * i + j, 12) for j in range(3)] for i in range(200)]
    got = _left(spark, ["\n".join([*banner, *x, footer]) for x in own])
    assert [r.text for r in got] == ["\n".join(x) for x in own]
    assert sum(r.n_dropped for r in got) == 600


def test_a_template_among_many_lines_of_its_leaf(spark):
    """Two templates and unrelated lines share token count and first tokens; passages of five documents go, too."""
    own = [_words(i, 30) for i in range(120)]
    head = "we thank all "
    mixed = [head + (f"friends of {_words(1000 + i, 1)} for their help" if i < 20 else f"members in {_words(2000 + i, 1)} who came along" if i < 40 else _words(3000 + i, 6)) for i in range(120)]
    passage = _words(77, 40)
    got = _left(spark, ["\n".join([o, m, *([passage] if 50 <= i < 55 else [])]) for i, (o, m) in enumerate(zip(own, mixed))])
    for i, r in enumerate(got):
        assert r.text == (own[i] if i < 40 else f"{own[i]}\n{mixed[i]}")


def test_short_lines_and_scripts_without_spaces(spark):
    """Short lines go from a higher count; a passage is long by its characters; blank lines, brackets and numbers stay."""
    chinese = "本网站所有内容版权归作者所有未经许可不得转载"
    rows = ["\n".join([_words(i, 40), "Read more" if i < 39 else "Go to top", chinese if i < 5 else "", "{", str(i)]) for i in range(100)]
    for i, r in enumerate(_left(spark, rows)):
        want = [_words(i, 40), *(["Read more"] if i < 39 else []), *([] if i < 5 else [""]), "{", str(i)]
        assert r.text.split("\n") == want


def test_near_copies_are_no_recurrence(spark):
    """A hot group of copies with single words replaced, a fifth of all lines of a third of all rows."""
    import random

    r, base = random.Random(1), [_words(100 + j, 40) for j in range(6)]
    copies = []
    for i in range(60):
        ls = [x.split() for x in base]
        for _ in range(4):
            ls[r.randrange(6)][r.randrange(40)] = _words(5000 + 10 * i, 1)
        copies.append("\n".join(map(" ".join, ls)))
    others = ["\n".join(_words(9000 + 10 * i + j, 30) for j in range(3)) for i in range(120)]
    got = _left(spark, ["The rules of this house are known to all\n" + t for t in copies + others])
    assert [x.text for x in got] == copies + others


def test_many_dropped_lines_in_one_text(spark):
    shared = [_words(i, 12) for i in range(lines.LIST + 20)]
    own = ["\n".join(_words(1000 * (i + 1) + j, 40) for j in range(40)) for i in range(8)]
    got = _left(spark, ["\n".join([o, *shared, *shared[:3]]) for o in own] + ["\n".join(shared)])
    assert [r.text for r in got] == [*own, ""] and [r.n_dropped for r in got] == [len(shared) + 3] * 8 + [len(shared)]


def test_copies_are_no_recurrence(spark):
    text = "\n".join(f"line number of this one document {chr(97 + i)} goes on and on" for i in range(3))
    df = spark.createDataFrame([(i, text) for i in range(500)], "doc_id long, text string")
    assert {(r.text, r.n_dropped) for r in lines.line_dedup(df).collect()} == {(text, 0)}


def test_odd_inputs(spark):
    df = spark.createDataFrame([(1, None, "n"), (2, "", "m"), (2, "", "m"), (3, "a b c d " * 50_000, "q")], "doc_id long, text string, n_lines string")
    got = sorted((r.doc_id, r.text is None, r.n_lines, r.n_dropped) for r in lines.line_dedup(df).collect())
    assert got == [(1, True, 0, 0), (2, False, 1, 0), (2, False, 1, 0), (3, False, 1, 0)]
    assert lines.line_dedup(df.limit(0)).collect() == []
    clash = spark.createDataFrame([(1, "x y", 1, 2, 3, 4)], "doc_id long, text string, body int, doc int, row int, drop int")
    assert lines.line_dedup(clash).columns == ["doc_id", "text", "body", "doc", "row", "drop", "n_lines", "n_dropped"]
