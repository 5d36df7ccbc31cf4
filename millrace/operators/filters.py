"""Scoring and filtering documents, and the cascades built from it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ENGLISH, OTHER, RULES, SPACE, Rule

#: Limits on repeated n-grams: a longer one may take a smaller share.
REPEATED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


def score(df: DataFrame, fn: Callable[[Column], Column], out: str, text_col: str = "text") -> DataFrame:
    """Add a score column."""
    return df.withColumn(out, fn(F.col(text_col)))


def keep(df: DataFrame, predicate: Column, invert: bool = False) -> DataFrame:
    """Keep rows for which the predicate is true, or false if inverted; null drops a row either way."""
    return df.where(~predicate if invert else predicate)


def score_filter(df: DataFrame, rule: Rule | str, text_col: str = "text", score_col: str | None = None, invert: bool = False) -> DataFrame:
    """Score, keep by the rule's range, and keep the score if it has a name."""
    rule = RULES[rule] if isinstance(rule, str) else rule
    value = rule.score(F.col(text_col))
    if score_col is None:
        return keep(df, rule.keep(value), invert)
    return keep(df.withColumn(score_col, value), rule.keep(F.col(score_col)), invert)


_SPACE = re.compile("[" + SPACE.replace("\\p{IsWhite_Space}", r"\s\x85\xa0") + "]+")


_BELOW_SPACE = re.compile("[\x00-\x08\x0e-\x1b]")


class Grams:
    """Runs of words of one text: words are hashed once, runs of any length come from that array."""

    def __init__(self, text: str):
        self.text, self.words = text, [x for x in _SPACE.split(text) if x]
        self.again, self.least = np.arange(len(self.words)), 0
        self.hashes = np.fromiter(map(hash, self.words), dtype=np.int64, count=len(self.words)).view(np.uint64)
        self.sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words)))])

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first places, counts) of runs of n words, and in ``again`` the places of those that occur more than once.

        A run is only repeated where the shorter ones before it were, so that lengths
        in rising order look at ever fewer places. A run left out occurs once.
        """
        count = len(self.words) - n + 1
        all_ = not 0 < self.least <= n
        at = np.arange(count) if all_ else self.again[self.again < count]
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(n if len(at) else 0):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[slice(k, k + count) if all_ else at + k]
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.zeros(1, dtype=np.int64)
        starts, counts = edges[:-1], edges[1:] - edges[:-1]
        self.again, self.least = np.sort(at[np.repeat(counts > 1, counts)]), n
        return at[starts], counts

    def repeated(self, n: int) -> float:
        """Share of characters in repeats of runs of n words, overlaps counted once; 1 for fewer words."""
        if len(self.words) < n:
            return 1.0
        first, counts = self.runs(n)
        if not len(self.again):
            return 0.0
        at = np.setdiff1d(self.again, first[counts > 1], assume_unique=True)
        fresh = np.minimum(n, np.diff(at, prepend=-n))  # words that no repeat before has counted
        return float((self.sizes[at + n] - self.sizes[at + n - fresh] + fresh - 1).sum()) / len(self.text)

    def top(self, n: int) -> float:
        """Share of the characters that the most frequent run takes; ties: the smallest run; 1 for fewer words."""
        if len(self.words) < n:
            return 1.0
        first, counts = self.runs(n)
        most = first[counts == counts.max()].tolist() if len(self.again) else range(len(self.words) - n + 1)
        if not _BELOW_SPACE.search(self.text):  # then the smallest run begins with the smallest word
            least = min(self.words[i] for i in most)
            most = (i for i in most if self.words[i] == least)
        best = min(" ".join(self.words[i : i + n]) for i in most)  # by code points, the order of UTF-8 too
        return (len(self.text) - len(self.text.replace(best, ""))) / len(self.text)


def duplicate_ngram_share(n: int) -> Callable:
    """Share of characters in repeats of word n-grams, overlaps counted once; fewer words than n give 1, null null."""
    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: Grams(t).repeated(n), na_action="ignore")

    return share


def repeats_within(limits: dict[int, float], top: dict[int, float] | None = None) -> Callable:
    """Whether all those shares, and those of the most frequent runs in ``top``, are within their limits; the first excess ends it."""
    @F.pandas_udf("boolean")
    def within(texts: pd.Series) -> pd.Series:
        def one(t: str) -> bool:
            g = Grams(t)
            return all(g.top(n) <= most for n, most in (top or {}).items()) and all(g.repeated(n) <= most for n, most in limits.items())

        return texts.map(one, na_action="ignore")

    return within


def cascade(df: DataFrame, rules: Iterable[str], text_col: str = "text") -> DataFrame:
    """All rules in one predicate: Catalyst evaluates them in order in one pass and stops at the first that fails."""
    t = F.col(text_col)
    ok = F.lit(True)
    for r in rules:
        ok = ok & RULES[r].keep(RULES[r].score(t))
    return df.where(ok)


def english_cascade(df: DataFrame, text_col: str = "text", repeated: bool = True) -> DataFrame:
    """The heuristic cascade for English text; all runs of words, which only Python counts fast, come last and at once."""
    return _cascade(df, ENGLISH, text_col, repeated)


def other_cascade(df: DataFrame, text_col: str = "text", repeated: bool = True) -> DataFrame:
    """The heuristic cascade for other languages."""
    return _cascade(df, OTHER, text_col, repeated)


def _cascade(df: DataFrame, rules: tuple[str, ...], text_col: str, repeated: bool) -> DataFrame:
    top = {int(r[4]): RULES[r].most for r in rules if r.startswith("top_")}
    df = cascade(df, [*(r for r in rules if not r.startswith("top_")), "bullets"], text_col)
    return df.where(repeats_within(REPEATED if repeated else {}, top)(F.col(text_col)))


def language_filter(df: DataFrame, score_col: str, label_col: str, language: str | None = None, least: float = 0.3) -> DataFrame:
    """Keep rows of a language (``en`` in any script, ``eng_Latn`` exactly) whose score reaches ``least``."""
    ok = F.col(score_col) >= least
    if language:
        label = F.lower(label_col)
        ok = ok & ((label == language.lower()) if "_" in language else (F.split_part(label, F.lit("_"), F.lit(1)) == language.lower()))
    return df.where(ok)


def quality_sample(df: DataFrame, score_col: str, alpha: float = 3.0, seed: int = 42) -> DataFrame:
    """Keep a row if a Pareto (Lomax) sample exceeds 1 - score: good rows nearly always, others by chance."""
    return df.where(F.pow(1 - F.rand(seed), F.lit(-1 / alpha)) - 1 > 1 - F.col(score_col))
