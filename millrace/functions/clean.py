"""Repair of broken Unicode in Arrow batches, with the standard library.

Where the library for it is installed, it does the work; without it a
documented part of its repairs is done: character references, text decoded
with the wrong single-byte encoding, terminal escapes, control characters,
line breaks, ligatures, widths, curly quotes, surrogates and normal forms.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = re.compile("\x1b\\[[0-?]*[ -/]*[@-~]")
_CONTROL = dict.fromkeys([*range(0x00, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0x206A, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFD)])
_QUOTES = dict.fromkeys([0x02BC, *range(0x2018, 0x201C)], "'") | dict.fromkeys(range(0x201C, 0x2020), '"')
_LIGATURES = {c: unicodedata.normalize("NFKC", chr(c)) for c in [0x132, 0x133, 0x149, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0xFB00, 0xFB07)]}
_WIDE = {c: unicodedata.normalize("NFKC", chr(c)) for c in [0x3000, *range(0xFF01, 0xFFF0)] if unicodedata.normalize("NFKC", chr(c)) != chr(c)}
#: UTF-8 read as a single-byte encoding: a lead byte, then continuation bytes.
_MOJIBAKE = re.compile("[\xc2-\xf4][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]+")
_TO_BYTE = {ord(bytes([b]).decode("cp1252", "ignore") or chr(b)): b for b in range(0x80, 0xA0)} | {b: b for b in range(0x80, 0x100)}


@dataclass(frozen=True)
class Repairs:
    """Which repairs are made; ``unescape_html`` "auto" leaves texts with a ``<`` alone."""

    unescape_html: str | bool = "auto"
    remove_terminal_escapes: bool = True
    fix_encoding: bool = True
    fix_c1_controls: bool = True
    fix_latin_ligatures: bool = False
    fix_character_width: bool = False
    uncurl_quotes: bool = False
    fix_line_breaks: bool = False
    fix_surrogates: bool = True
    remove_control_chars: bool = True
    normalization: str | None = None


def _decode(m: re.Match) -> str:
    try:
        return bytes(_TO_BYTE[ord(c)] for c in m[0]).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return m[0]


def repair(t: str, how: Repairs = Repairs()) -> str:
    """One text, repaired until nothing changes (at most a few rounds)."""
    for _ in range(4):
        old = t
        if how.unescape_html is True or how.unescape_html == "auto" and "<" not in t:
            t = html.unescape(t)
        if how.remove_terminal_escapes:
            t = _ESCAPES.sub("", t)
        if how.fix_encoding:
            t = _MOJIBAKE.sub(_decode, t)
        if how.fix_c1_controls:
            t = re.sub("[\x80-\x9f]", lambda m: m[0].encode("latin-1").decode("cp1252", "ignore") or m[0], t)
        if how.fix_latin_ligatures:
            t = t.translate(_LIGATURES)
        if how.fix_character_width:
            t = t.translate(_WIDE)
        if how.uncurl_quotes:
            t = t.translate(_QUOTES)
        if how.fix_line_breaks:
            t = re.sub("\r\n|[\r\x85  ]", "\n", t)
        if how.fix_surrogates:
            t = t.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if how.remove_control_chars:
            t = t.translate(_CONTROL)
        if how.normalization:
            t = unicodedata.normalize(how.normalization, t)
        if t == old:
            break
    return t


def repair_unicode(t: Column, how: Repairs = Repairs()) -> Column:
    """A text column, repaired; null stays null."""
    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        try:
            import ftfy
        except ImportError:
            return s.map(lambda x: None if x is None else repair(x, how))
        options = {k: v for k, v in how.__dict__.items()}
        return s.map(lambda x: None if x is None else ftfy.fix_text(x, **options))

    return fix(t)
