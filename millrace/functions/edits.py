"""Edit distances of words and characters, with the kinds of edits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that the clean form drops, and what it turns into a space or nothing.
MARKS = "،؟.、？¿!,?।"
TO_SPACE = '/*":=_-{|}~¨«·»¡¿…‧‹›≪≫!:;ː→'
TO_NOTHING = '`¨´‘’“”ʻ-"'
#: Least half width of the band in which distances are looked for.
BAND = 16
#: By how much the limits of a search pass the least cost, one after the other.
SLACK = (0, 2, 8, 32, 128, 512)
DETAIL = "struct<rate:double,tokens:long,ins_rate:double,del_rate:double,sub_rate:double>"


def edits(ref: Sequence, hyp: Sequence) -> tuple[int, int, int]:
    """(insertions, deletions, substitutions) of a cheapest way from ``ref`` to ``hyp``.

    Equal ends are left out, which changes no count. Alike sequences are then
    settled by few states of a search along diagonals; others row by row in
    numpy, inside a band around the diagonal that grows until the cost fits in
    it: no cheapest way leaves a band as wide as its cost. Insertions along a
    row are a running minimum. Costs carry the counts in their low bits: of
    equal costs the one with fewer insertions wins.
    """
    r, h = _codes(ref, hyp)
    shorter = min(len(r), len(h))
    a = _first(r[:shorter] != h[:shorter])
    b = _first(r[len(r) - shorter + a :][::-1] != h[len(h) - shorter + a :][::-1])
    r, h = r[a : len(r) - b], h[a : len(h) - b]
    if not len(r) or not len(h):
        return len(h), len(r), 0
    found = _searched(r, h)
    if found is None:
        most, band = max(len(r), len(h)), max(BAND, abs(len(r) - len(h)))
        while (total := _banded(r, h, min(band, most))) >> 32 > band and band < most:
            band *= 4
        found = total >> 32, total & ((1 << 32) - 1)
    cost, n_ins = found
    n_del = n_ins + len(r) - len(h)
    return n_ins, n_del, cost - n_ins - n_del


def _codes(ref: Sequence, hyp: Sequence) -> list[np.ndarray]:
    """Tokens as numbers; characters of strings as they are."""
    if isinstance(ref, str) and isinstance(hyp, str):
        return [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for s in (ref, hyp)]
    index: dict = {}
    return [np.fromiter((index.setdefault(x, len(index)) for x in s), dtype=np.uint32, count=len(s)) for s in (ref, hyp)]


def _first(differs: np.ndarray) -> int:
    """Where the first true value stands, or the length."""
    return int(differs.argmax()) if differs.any() else len(differs)


def _searched(r: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
    """(cost, insertions) of alike sequences; None when that takes too many states.

    By cost, the furthest place on each diagonal for each number of insertions:
    of two places on a diagonal none is worse off than the one before it. A
    place is dropped when its cost and what it still needs pass the limit: one
    for each token that the other side lacks, and the steps to the last
    diagonal. The limit starts just above what the whole needs and grows, up to
    the cost of a way along one diagonal, which has the fewest insertions.
    """
    n, m, goal = len(r), len(h), len(h) - len(r)
    steps, few, same = abs(goal), max(0, goal), min(n, m)
    plain = steps + min(int(np.count_nonzero(r[:same] != h[:same])), int(np.count_nonzero(r[n - same :] != h[m - same :])))
    need_r, need_h = (np.concatenate([np.cumsum(~np.isin(x, y)[::-1])[::-1], [0]]) for x, y in ((r, h), (h, r)))
    least, left = max(int(need_r[0]) + few, int(need_h[0]) + few - goal, steps), 2 * (n + m) + 500

    def slide(k: int, i: int) -> int:
        """The first place from ``i`` on, on diagonal ``k``, where tokens differ or a side ends."""
        end, block = min(n, m - k), 32
        while i < end and r[i] == h[i + k]:
            stop = min(end, i + block)
            i, block = i + _first(r[i:stop] != h[i + k : stop + k]), 2 * block
        return i

    for extra in SLACK:
        limit, cost = min(least + extra, plain - 1), 0
        places = {(0, 0): slide(0, 0)}  # (diagonal, insertions): place in r
        while places and cost <= limit:
            done = [e for (k, e), i in places.items() if k == goal and i == n]
            if done:
                return cost, min(done)
            left -= len(places)
            if left < 0:
                return None
            cost, new = cost + 1, {}
            for (k, e), i in places.items():
                for key, to in (((k, e), i + 1), ((k - 1, e), i + 1), ((k + 1, e + 1), i)):
                    if to <= n and to + key[0] <= m and to > new.get(key, -1):
                        new[key] = to
            places = {}
            for (k, e), i in sorted(new.items(), key=lambda x: x[0][1]):
                ahead = max(0, goal - k)
                if cost + max(int(need_r[i]) + ahead, int(need_h[i + k]) + ahead - goal + k) > limit:
                    continue
                i = slide(k, i)
                if all(places.get((k, f), -1) < i for f in range(max(0, k), e)):
                    places[k, e] = i
        if limit == plain - 1:
            return plain, few
    return None


def _banded(r: np.ndarray, h: np.ndarray, band: int) -> int:
    """Cost in the high part and insertions in the low part, by ways at most ``band`` off the diagonal."""
    one, ins, never = 1 << 32, (1 << 32) + 1, 1 << 61
    steps = np.arange(2 * band + 1, dtype=np.int64) * ins
    row = np.concatenate([np.full(band, never), steps[: band + 1]])
    wide = np.concatenate([np.full(band, -1), h, np.full(len(r) + band - len(h), -1)])
    for i, x in enumerate(r.tolist(), 1):
        new = row + np.where(wide[i - 1 : i + 2 * band] == x, 0, one)
        new[:-1] = np.minimum(new[:-1], row[1:] + one)
        new[: max(0, band - i)] = never
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[len(h) - len(r) + band])


def error_rates(refs: list[Sequence], hyps: list[Sequence]) -> dict:
    """Rates over all tokens of the references; infinite where there are none but insertions."""
    n = sum(map(len, refs))
    total = np.sum([edits(r, h) for r, h in zip(refs, hyps)], axis=0) if refs else np.zeros(3)
    rate = lambda k: float(k) / n if n else (float("inf") if k else 0.0)
    return {"rate": rate(total.sum()), "tokens": n, "ins_rate": rate(total[0]), "del_rate": rate(total[1]), "sub_rate": rate(total[2])}


def clean_transcript(t: Column) -> Column:
    """Lower case, without punctuation and quotes, single spaces; apostrophes stay."""
    t = F.translate(F.lower(t), TO_NOTHING, "")
    t = F.translate(t, TO_SPACE + MARKS, " " * len(TO_SPACE + MARKS))
    return F.trim(F.regexp_replace(t, r"[\s\x{3000}]+", " "))


def _detail(split, edge: int | None = None, digits: int | None = 4):
    @F.pandas_udf(DETAIL)
    def rates(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
        rows = []
        for r, h in zip(ref, hyp):
            if r is None or h is None or not r:
                rows.append(dict.fromkeys(("rate", "tokens", "ins_rate", "del_rate", "sub_rate")))
                continue
            if edge:
                r, h = (r[:edge], h[:edge]) if edge > 0 else (r[edge:], h[edge:])
            d = error_rates([split(r)], [split(h)])
            rows.append({k: round(v, digits) if isinstance(v, float) and digits is not None else v for k, v in d.items()})
        return pd.DataFrame(rows, columns=["rate", "tokens", "ins_rate", "del_rate", "sub_rate"])

    return rates


def word_errors(ref: Column, hyp: Column) -> Column:
    """Word error rate with its kinds; null for a null or empty reference."""
    return _detail(str.split)(ref, hyp)


def char_errors(ref: Column, hyp: Column, edge: int | None = None) -> Column:
    """Character error rate; ``edge`` looks at the first (or, negative, the last) so many characters."""
    return _detail(str, edge)(ref, hyp)


def pair_error_percent(ref: Column, hyp: Column) -> Column:
    """Word error rate of two transcripts in percent, four digits."""
    return F.round(_detail(str.split, digits=None)(ref, hyp)["rate"] * 100, 4)


def rate_per_second(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.round(n / seconds, 2)).otherwise(F.lit(0.0))
