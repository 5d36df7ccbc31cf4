"""Scores of source code: comments, visible text of HTML, rules by file extension.

What needs a parser runs as an Arrow-batched function; the rest is Column
expressions. A null text has a null score.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score of a text whose comments can't be read.
UNREADABLE = 9999.0
#: What starts and ends comments, by language: (line starts, block pairs, quotes of strings).
_C = (("//",), (("/*", "*/"),), "\"'")
_HASH = (("#",), (), "\"'")
SYNTAX = {
    "text/x-c": _C, "text/x-c++": _C, "text/x-java-source": _C, "text/x-java": _C, "text/x-go": _C, "text/x-rust": _C, "application/javascript": _C, "text/javascript": _C, "text/css": _C,
    "text/x-python": _HASH, "text/x-shellscript": _HASH, "text/x-ruby": _HASH, "text/html": ((), (("<!--", "-->"),), ""), "text/xml": ((), (("<!--", "-->"),), ""),
}


def python_natural_text(source: str) -> int:
    """Characters of comments, as laid out by a token stream of nothing else, and of docstrings; 0 if it doesn't parse."""
    try:
        docs = []
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef)) and (d := ast.get_docstring(node)):
                docs.append(d)
        marks = [(t.type, t.string) for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT]
        return len("\n".join(docs)) + len(tokenize.untokenize(marks))
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError, MemoryError):
        return 0


@cache
def _scanner(language: str) -> re.Pattern:
    """Strings, comments to the end of a line and blocks, in this order; group ``x`` is a block that doesn't end."""
    line_marks, blocks, quotes = SYNTAX[language]
    parts = [f"{q}(?:[^{q}\\\\\n]|\\\\.)*+[{q}\n]?" for q in quotes]
    parts += [f"{re.escape(m)}(?P<l{i}>[^\n]*)" for i, m in enumerate(line_marks)]
    parts += [f"{re.escape(a)}(?:(?P<b{i}>.*?){re.escape(z)}|(?P<x{i}>))" for i, (a, z) in enumerate(blocks)]
    return re.compile("|".join(parts), re.S)


def comments(source: str, language: str) -> list[str]:
    """Texts of all comments without their marks. Comment marks inside strings don't count."""
    out = []
    for m in _scanner(language).finditer(source):
        if kind := m.lastgroup:
            if kind[0] == "x":
                raise ValueError("a comment doesn't end")
            out.append(m[kind])
    return out


class _Visible(HTMLParser):
    """Text outside scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_text(source: str) -> str:
    p = _Visible()
    p.feed(source)
    p.close()
    return "".join(p.parts)


def _scored(fn):
    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else fn(x))

    return score


def python_comment_share(t: Column) -> Column:
    """Comments and docstrings over all characters; 0 if the source doesn't parse, null for an empty one."""
    return _scored(lambda s: python_natural_text(s) / len(s) if s else None)(t)


def comment_share(t: Column, language: str) -> Column:
    """Characters of comments over all; ``UNREADABLE`` where they can't be told, null for an empty text."""
    def share(s: str) -> float | None:
        try:
            return len(" ".join(comments(s, language))) / len(s) if s else None
        except (ValueError, KeyError):
            return UNREADABLE

    return _scored(share)(t)


def html_visible_share(t: Column, least_chars: int = 100) -> Column:
    """Visible characters over all; 0 below ``least_chars`` visible ones, null for an empty text."""
    def share(s: str) -> float | None:
        if not s:
            return None
        n = len(visible_text(s))
        return 0.0 if n < least_chars else n / len(s)

    return _scored(share)(t)


def fertility(t: Column, model_path: str) -> Column:
    """Characters a token of a sentencepiece model; -1 for a text without tokens."""
    model: list = []

    def share(s: str) -> float:
        if not model:
            import sentencepiece

            model.append(sentencepiece.SentencePieceProcessor(model_file=model_path))
        n = len(model[0].encode(s))
        return len(s) / n if n else -1.0

    return _scored(share)(t)


def extension_rules(df: DataFrame, rules: DataFrame, language: str, extension_col: str = "extension", text_col: str = "text", out: str = "keep") -> DataFrame:
    """Add 1 or 0: whether the rules of the row's language and extension keep it.

    ``rules`` has (language, extension, include, longest_line, alnum_share,
    alpha_share), null for a rule that doesn't apply; with a limit on the
    longest line the mean line may have 100 characters. Extensions without a
    rule aren't kept; a null extension counts as "". The rules are a small
    table, which the planner broadcasts.
    """
    name = {"C#": "c-sharp", "F#": "f-sharp"}.get(language, language.lower().replace(" ", "-"))
    cols = ("include", "longest_line", "alnum_share", "alpha_share")
    r = rules.where(F.col("language") == name).select(F.col("extension").alias("__ext"), *(F.col(c).alias(f"__{c}") for c in cols)).dropDuplicates(["__ext"])
    t = F.col(text_col)
    parts = F.split(t, "\n")
    longest, mean = F.array_max(F.transform(parts, F.length)), (F.length(t) + 1) / F.size(parts) - 1
    count = lambda p: F.regexp_count(t, F.lit(p))
    limited = F.coalesce(F.col("__longest_line"), F.lit(0)) > 0
    bad = (limited & ((longest > F.col("__longest_line")) | (mean > 100))) | F.coalesce(count("[a-zA-Z0-9]") < F.col("__alnum_share") * F.length(t), F.lit(False))
    bad = bad | F.coalesce(count(r"\p{L}") < F.col("__alpha_share") * F.length(t), F.lit(False))
    kept = F.when(t.isNull(), None).when(F.coalesce(F.col("__include"), F.lit(False)) & ~bad, 1).otherwise(0)
    joined = df.join(r, F.coalesce(F.col(extension_col), F.lit("")) == F.col("__ext"), "left")
    return joined.withColumn(out, kept).drop("__ext", *(f"__{c}" for c in cols))
