"""Scores and rewritings against plain Python on strings that break naive versions."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import clean, code, modify, text
from millrace.operators import filters

STRINGS = [
    "", "   ", "a", "one two three", "U+3000　and more", "a\x1cb\x1dc\x1ed\x1fe", "zero​width", "\U0001f600 emoji \U0001f600", "x\r\ny\r\n\r\n", "line sep", "# ## #a ...", "… read more", "Ⅷ ١٢٣ é",
    "w" * 1001, "• item\n• item\nend.", "the the the with have", "http://a.b/c porn http://porn.x/y", "(a) [b] {c} ⟨d⟩", "A line.\nA line.\n\nA line.", "<?xml version='1.0'?>", "Privacy Policy here\n\nbody\n\nmore",
    "lorem ipsum dolor", '"quoted"', '"first"\nsecond"', "**bold** *it* _u_ [t](u)", "a\n\n\n\nb", "tab\there", "ends with…", "don't read more", None,
]
WS = re.compile(r"[\s\x1c-\x1f\x85]+")


def words(t):
    return t.split()


def lines(t):
    return [x for x in t.split("\n") if x.strip()]


PYTHON = {
    "word_count": lambda t: len(words(t)),
    "mean_word_length": lambda t: sum(map(len, words(t))) / len(words(t)) if words(t) else None,
    "longest_word": lambda t: max(map(len, words(t)), default=None),
    "non_alpha_numeric": lambda t: (len(t) - len(re.findall(r"[a-zA-Z0-9\n?!,.]", t))) / len(t) if t else 1.0,
    "numbers": lambda t: len(re.findall("[0-9]", t)) / len(t) if t else 1.0,
    "parentheses": lambda t: sum(c in "(){}[]⟨⟩" for c in t) / len(t) if t else 1.0,
    "white_space": lambda t: sum(c in "\t\n\r\x08 " for c in t) / len(t) if t else 1.0,
    "distinct_lines": lambda t: len(set(lines(t))) / len(lines(t)) if lines(t) else None,
    "distinct_paragraphs": lambda t: len(set(t.split("\n\n"))) / len(t.split("\n\n")),
    "without_end_mark": lambda t: sum(not x.strip().endswith((".", "?", "!", '"', "'")) for x in lines(t)) / len(lines(t)) if lines(t) else None,
    "common_words": lambda t: min(2, sum(w in text.COMMON for w in words(t))),
    "lines_of_code": lambda t: t.count("\n") + 1,
    "xml_header": lambda t: float("<?xml version=" in t[:100]),
}


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(STRINGS)], "i int, text string")


@pytest.mark.parametrize("name", sorted(PYTHON))
def test_scores(strings, name):
    got = {r.i: r.s for r in strings.select("i", text.RULES[name].score(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(STRINGS):
        want = None if t is None else PYTHON[name](t)
        assert got[i] == (want if want is None else pytest.approx(want)), (name, t)


def test_filters_drop_null_scores_inverted_too(strings):
    rule = "mean_word_length"
    a = {r.i for r in filters.score_filter(strings, rule).collect()}
    b = {r.i for r in filters.score_filter(strings, rule, invert=True).collect()}
    none = {i for i, t in enumerate(STRINGS) if t is None or not t.split()}
    assert not a & b and not (a | b) & none and a | b | none == set(range(len(STRINGS)))


@pytest.mark.parametrize("n", [2, 3])
def test_duplicate_ngrams(spark, n):
    t = "a b c a b c a b x y a b"
    df = spark.createDataFrame([(t,), ("a",), ("",), (None,)], "text string")
    got = [r.s for r in df.select(filters.duplicate_ngram_share(n)(F.col("text")).alias("s")).collect()]
    w, seen, chars, done = t.split(), set(), 0, 0
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            fresh = w[max(i, done) : i + n]
            chars, done = chars + len("".join(fresh)) + len(fresh) - 1, i + n
        seen.add(g)
    assert got == [pytest.approx(chars / len(t)), 1.0, 1.0, None]


def test_top_ngram_takes_the_most_frequent(spark):
    df = spark.createDataFrame([("x y x y z q",), ("one",), (None,)], "text string")
    got = [r.s for r in df.select(text.top_ngram(F.col("text"), 2).alias("s")).collect()]
    assert got == [pytest.approx(6 / 11), 1.0, None]


@pytest.mark.parametrize(("args", "given", "want"), [
    (dict(left=2, right=5), "abcdefg", "cde"), (dict(left=-3), "abcdefg", "efg"), (dict(left="b", right="f"), "abcdefbfg", "bcdefbf"), (dict(left="b", include_left=False, right="f", include_right=False), "abcdefbfg", "cdefb"),
    (dict(left="z"), "abc", ""), (dict(right=-1, trim=False), " ab ", " ab"), (dict(), " ab ", "ab"), (dict(left=5, right=2), "abcdefg", ""),
])
def test_slices(spark, args, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(modify.slice_text(F.col("t"), **args).alias("s")).first().s == want


def test_quotes_and_boilerplate(spark):
    run = lambda fn, t: spark.createDataFrame([(t,)], "t string").select(fn(F.col("t")).alias("s")).first().s
    assert run(modify.remove_quotation, '"abc"') == "abc"
    assert run(modify.remove_quotation, '"a"\nb"') == '"a"\nb"'
    assert run(modify.remove_quotation, '""') == '""'
    assert run(modify.remove_boilerplate, "Privacy Policy\n\nbody") == "body"
    assert run(modify.remove_boilerplate, "a\n\nprivacy policy\n\nb") == "a\n\nprivacy policy\n\nb"
    assert run(modify.remove_boilerplate, "x lorem ipsum") == ""
    assert run(modify.remove_boilerplate, None) is None
    assert run(modify.normalize_newlines, "a\n\n\n\nb\r\n\r\n\r\n\r\nc") == "a\n\nb\r\n\r\nc"


def test_code_scores(spark):
    source = '"""Doc."""\n# note\nx = 1  # more\n\ndef f():\n    "inner"\n    return "# no"\n'
    df = spark.createDataFrame([(source,), ("def (",), ("",), (None,)], "t string")
    got = [r.s for r in df.select(code.python_comment_share(F.col("t")).alias("s")).collect()]
    assert 0 < got[0] < 1 and got[1:] == [0.0, None, None]
    assert code.comments('a // one\n"// no" /* two */ b', "text/x-c") == [" one", " two "]
    with pytest.raises(ValueError):
        code.comments("/* open", "text/x-c")
    page = "<html><script>var x;</script><body><p>" + "hello world " * 20 + "</p></body></html>"
    got = [r.s for r in spark.createDataFrame([(page,), ("<p>short</p>",)], "t string").select(code.html_visible_share(F.col("t")).alias("s")).collect()]
    assert got == [pytest.approx(240 / len(page)), 0.0]


def test_unicode_repair():
    assert clean.repair("cafÃ©") == "café"
    assert clean.repair("&lt;b&gt; \x1b[31mred\x1b[0m\x00") == "<b> red"
    assert clean.repair("<a> &amp;") == "<a> &amp;"
    assert clean.repair("plain ünïcode ’quote’") == "plain ünïcode ’quote’"
    assert clean.repair("ﬁx", clean.Repairs(fix_latin_ligatures=True)) == "fix"


def _repeated(w: list[str], n: int) -> int:
    """Characters in repeats of runs of n words, overlaps counted once, run by run."""
    seen, chars, done = set(), 0, 0
    for i in range(len(w) - n + 1):
        gram = tuple(w[i : i + n])
        if gram in seen:
            fresh = w[max(i, done) : i + n]
            chars += sum(map(len, fresh)) + len(fresh) - 1
            done = i + n
        seen.add(gram)
    return chars


def test_runs_of_words_against_plain_counts():
    import random
    from collections import Counter

    from millrace.operators.filters import Grams

    rng = random.Random(5)
    for _ in range(200):
        w = [rng.choice(["a", "bb", "ccc", "ü"]) for _ in range(rng.randint(1, 40))]
        t = " ".join(w)
        for n in (2, 3, 5, 10):
            g = Grams(t)
            assert g.repeated(n) == (_repeated(w, n) / len(t) if len(w) >= n else 1.0)
            runs = Counter(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
            best = min((x for x, c in runs.items() if c == max(runs.values())), key=str.encode, default=None)
            assert g.top(n) == ((len(t) - len(t.replace(best, ""))) / len(t) if best else 1.0)


def test_policy_phrases_are_whole(spark):
    """A paragraph with a fragment of a long phrase is none with the phrase."""
    from millrace.functions import text

    rows = [("x\n\nnecessary cookies are absolutely essential",), ("x\n\n" + text.POLICY[10].upper(),), ("x\n\nread our Privacy Policy",), ("x\n\ny",)]
    got = spark.createDataFrame(rows, "t string").select(text.boilerplate(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == [0.0, 0.5, 0.5, 0.0]


def test_comments_against_a_scan_by_characters():
    """The same comments as a scan character by character, in a small part of its time."""
    import random
    import time

    def scan(source: str, language: str) -> list[str]:
        line_marks, blocks, quotes = code.SYNTAX[language]
        out, i, n = [], 0, len(source)
        while i < n:
            c = source[i]
            if c in quotes and quotes:
                j = i + 1
                while j < n and source[j] != c and source[j] != "\n":
                    j += 2 if source[j] == "\\" else 1
                i = j + 1
            elif mark := next((m for m in line_marks if source.startswith(m, i)), None):
                j = source.find("\n", i)
                j = n if j < 0 else j
                out.append(source[i + len(mark) : j])
                i = j
            elif block := next((b for b in blocks if source.startswith(b[0], i)), None):
                j = source.find(block[1], i + len(block[0]))
                if j < 0:
                    raise ValueError
                out.append(source[i + len(block[0]) : j])
                i = j + len(block[1])
            else:
                i += 1
        return out

    def told(fn, *x):
        try:
            return fn(*x)
        except ValueError:
            return None

    rng = random.Random(3)
    for language in code.SYNTAX:
        for _ in range(400):
            s = "".join(rng.choice(["a", "\n", '"', "'", "\\", "#", "//", "/*", "*/", "<!--", "-->", "/", "*"]) for _ in range(rng.randrange(30)))
            assert told(code.comments, s, language) == told(scan, s, language), (language, s)
    long, seconds = "some words 'of' text, and # more\n" * 30_000, []
    for fn in (code.comments, scan):
        start = time.process_time()
        assert len(fn(long, "text/x-python")) == 30_000
        seconds.append(time.process_time() - start)
    assert seconds[0] * 4 < seconds[1]


def test_runs_of_words_look_at_fewer_places_as_they_grow():
    """Longer runs are looked for only where shorter ones are repeated; results are those of plain counting."""
    import random
    from collections import Counter

    rng = random.Random(4)
    for size in (0, 1, 3, 30, 400):
        for letters in ("ab", "abcdefgh", "a\x01b!"):
            ws = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(size)]
            t = " ".join(ws)
            g = filters.Grams(t)
            for n in (2, 3, 4):
                runs = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)]
                if runs:
                    best = min(Counter(runs).items(), key=lambda x: (-x[1], x[0].encode()))[0]
                    assert g.top(n) == (len(t) - len(t.replace(best, ""))) / len(t)
                    assert len(g.again) == sum(c for c in Counter(runs).values() if c > 1)
                else:
                    assert g.top(n) == 1.0
    g = filters.Grams(" ".join(map(str, range(1000))))
    assert g.top(2) < 0.01 and not len(g.again) and g.repeated(5) == 0.0
