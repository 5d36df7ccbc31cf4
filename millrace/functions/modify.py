"""Rewritings of texts as Column expressions; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_policy, paragraphs, strip

# What the modifiers look for.
URLS = r"(?i)https?://\S+|www\.\S+"
BOLD = r"(?d)\*\*(.*?)\*\*"
ITALIC = r"(?d)\*(.*?)\*"
UNDERLINE = r"(?d)_(.*?)_"
LINK = r"(?d)\[.*?\]\((.*?)\)"
NEWLINES = "\n{3,}"
CARRIAGE_NEWLINES = "(\r\n){3,}"


def remove_urls(t: Column) -> Column:
    return F.regexp_replace(t, URLS, "")


def remove_lines(t: Column, patterns: list[str]) -> Column:
    """Drop lines that equal one of the patterns."""
    return F.array_join(F.filter(F.split(t, "\n"), lambda s: ~s.isin(*patterns)), "\n")


def remove_markdown(t: Column) -> Column:
    """Bold, italics, underscores and links lose their marks."""
    for pattern in (BOLD, ITALIC, UNDERLINE, LINK):
        t = F.regexp_replace(t, pattern, "$1")
    return t


def normalize_newlines(t: Column) -> Column:
    t = F.regexp_replace(t, NEWLINES, "\n\n")
    return F.regexp_replace(t, CARRIAGE_NEWLINES, "\r\n\r\n")


def remove_quotation(t: Column) -> Column:
    """Drop the quotes around a whole text, unless its first line ends with one."""
    s = strip(t)
    first = F.substring_index(s, "\n", 1)
    quoted = (F.length(s) > 2) & F.startswith(s, F.lit('"')) & F.endswith(s, F.lit('"'))
    alone = ~F.contains(s, F.lit("\n")) | ~F.endswith(first, F.lit('"'))
    return F.when(quoted & alone, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(t)


def slice_text(t: Column, left: int | str = 0, right: int | str | None = None, include_left: bool = True, include_right: bool = True, trim: bool = True) -> Column:
    """What lies between two places, numbers as in Python or strings (first left, last right); a missing string gives ""."""
    n = F.length(t)

    def place(x: int) -> Column:
        return F.least(F.lit(x), n) if x >= 0 else F.greatest(n + x, F.lit(0))

    missing = F.lit(False)
    if isinstance(left, str):
        at = F.instr(t, left)
        missing, start = missing | (at == 0), at - 1 + (0 if include_left else len(left))
    else:
        start = place(left)
    if isinstance(right, str):
        back = F.instr(F.reverse(t), right[::-1])
        missing, stop = missing | (back == 0), n - back + 1 - (0 if include_right else len(right))
    else:
        stop = n if right is None else place(right)
    out = F.when(missing | (stop <= start), F.lit("")).otherwise(F.substring(t, start + 1, stop - start))
    out = strip(out) if trim else out
    return F.when(t.isNotNull(), out)


def remove_boilerplate(t: Column, at_ends: bool = True) -> Column:
    """Drop policy paragraphs that stand together at the top or the bottom.

    With ``lorem ipsum`` the result is "". Unless the policy paragraphs are
    contiguous, touch an end and aren't all there is, the text is unchanged;
    with ``at_ends=False`` any of them gives "".
    """
    p = paragraphs(t)
    policy = lambda x: has_policy(F.lower(x))
    at = F.filter(F.transform(p, lambda x, i: F.when(policy(x), i)), lambda i: i.isNotNull())
    together = F.array_max(at) - F.array_min(at) + 1 == F.size(at)
    touches = (F.array_min(at) == 0) | (F.array_max(at) == F.size(p) - 1)
    cut = F.array_join(F.filter(p, lambda x: ~policy(x)), "\n\n") if at_ends else F.lit("")
    some = F.when(together & touches & (F.size(at) < F.size(p)), cut).otherwise(t) if at_ends else cut
    return F.when(F.contains(F.lower(t), F.lit("lorem ipsum")), F.lit("")).when(F.size(at) == 0, t).when(t.isNotNull(), some)


def label_line(t: Column, label: str) -> Column:
    """One training line of a label and a text without line breaks or label marks."""
    return F.concat_ws(" ", F.lit(label), F.replace(F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("__label__"), F.lit(" ")))


def center_crop(t: Column, n: int) -> Column:
    """Up to n characters on each side of the middle."""
    mid = (F.length(t) / 2).cast("int")
    start = F.greatest(mid - n, F.lit(0))
    return F.substring(t, start + 1, F.least(mid + n, F.length(t)) - start)
