"""Bucket identifiers of all positions of a text, by pointer refinement.

A position's bucket at depth 8 is the 8 bytes that start there. The bucket at
twice the depth is named by two identifiers of the depth before: the position's
own and that of the later offset it points to. Names are 64-bit mixes of the two
instead of ranks, so that all executors give a bucket the same name and buckets
can be compared across texts without a global sort.
"""

from __future__ import annotations

import numpy as np

#: Depth of the buckets that anchors are drawn from.
GRAM = 64
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
#: Low bits of an anchor's order that hold its place; a text may have 2**34 bytes.
_PLACE = 34


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a bucket from the identifiers at a position and at a later offset."""
    x = a * _A + (b ^ (b >> np.uint64(31))) * _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x ^ (x >> np.uint64(29))


def initial(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position."""
    n = len(raw) - 7
    out = np.empty(max(n, 0), dtype=np.uint64)
    for o in range(min(8, max(n, 0))):
        k = (len(raw) - o) // 8
        out[o::8] = np.frombuffer(raw.tobytes() if o == 0 else raw[o:].tobytes(), dtype="<u8", count=k)[: len(out[o::8])]
    return out


def deepen(names: np.ndarray, depth: int, to: int) -> np.ndarray:
    """Identifiers at depth ``to`` from those at ``depth`` (to at most twice depth)."""
    step = to - depth
    return pair(names[: len(names) - step], names[step:])


def refine(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Identifiers at depth ``GRAM``, at the last power of two up to ``length`` (given last) and at ``length``."""
    names, depth, gram = initial(raw), 8, None
    while depth * 2 <= length:
        names = deepen(names, depth, depth * 2)
        depth *= 2
        if depth == GRAM:
            gram = names
    return gram, names, deepen(names, depth, length) if depth < length else names, depth


def anchors(gram: np.ndarray, windows: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of a text: place, first and last window of each.

    A window's anchor is the least, and of equals the leftmost, of the ``span``
    grams inside it, so equal windows have equal anchors at equal places.
    """
    mixed = gram * _B
    key = ((mixed ^ (mixed >> np.uint64(32))) * _C) >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width < span:
        step = min(width, span - width)
        key = np.minimum(key[: len(key) - step], key[step:])
        width += step
    at = (key[:windows] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:], [windows]]) - 1
