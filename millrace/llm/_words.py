"""Words of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE, Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, dtype=np.uint64)
    up = np.cumprod(np.concatenate([one, np.full(n, BASE, dtype=np.uint64)]))
    down = np.cumprod(np.concatenate([one, np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)]))
    return up, down


class Words(NamedTuple):
    raw: np.ndarray  # bytes of the block, lower-cased
    first: np.ndarray  # where each word begins and ends
    last: np.ndarray
    hashes: np.ndarray
    ends: np.ndarray  # words up to the end of each text


def hash_words(block: list[bytes]) -> Words:
    """All words of a block of texts. Separators are the space and 0x09 to 0x0D; A-Z count as lower case."""
    raw = np.frombuffer(b" ".join([*block, b""]).translate(LOWER), dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in block])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SEP[raw], [True]]).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]
    up, down = _powers(1 << max(16, int(len(raw)).bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(Q))
    return Words(raw, first, last, hashes, np.searchsorted(first, ends))


def blocks(texts: list[str], size: int = 1_000_000):
    """Lists of whole encoded texts, about ``size`` bytes at a time."""
    part, n = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        if part and n + len(raw) > size:
            yield part
            part, n = [], 0
        part.append(raw)
        n += len(raw)
    if part:
        yield part
