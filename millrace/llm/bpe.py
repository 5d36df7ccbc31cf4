"""Byte-level BPE encoding and decoding: speculate and verify.

Greedy longest-match proposes the tokens of a word. A word's proposal is the
BPE result exactly if every adjacent pair of tokens is compatible, that is, if
no merge across the border would have come before the merges that made the two
tokens. All pairs of a batch are tested at once in numpy; only words with a
failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.session import read_table

from ._rows import add_columns, int_lists, texts

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _pattern(letter: str, number: str, either: str) -> str:
    return rf"'(?:[stmd]|re|ve|ll)| ?{letter}+| ?{number}+| ?{either}+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


_WORDS = regex.compile(_pattern(r"\p{L}", r"\p{N}", rf"[^{_WS}\p{{L}}\p{{N}}]"))
#: For texts below U+0558 the standard module with classes spelled out is four times as fast.
_HIGH = re.compile("[\u0558-\U0010ffff]")
_LOW = {k: "".join(regex.findall(rf"\p{{{k}}}", "".join(map(chr, range(0x558))))) for k in "LN"}
_WORDS_LOW = re.compile(_pattern(f"[{_LOW['L']}]", f"[{_LOW['N']}]", f"[^{_WS}{_LOW['L']}{_LOW['N']}]"))
#: Characters that are letters or numbers only in a Unicode version later than
#: the tokenizers library knows; there they count as neither.
_LATE = (
    "՘֋֌࢏౜೜₏₝-₟꟎꟏꟒꟔꟝꟢꟱꭬꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_HAS_LATE = regex.compile(f"[{_LATE}]")
_WORDS_LATE = regex.compile(
    _pattern(rf"(?:(?![{_LATE}])\p{{L}})", rf"(?:(?![{_LATE}])\p{{N}})", rf"(?:[{_LATE}]|[^{_WS}\p{{L}}\p{{N}}])")
)
#: Distinct words whose tokens a worker remembers; beyond, it starts afresh.
CACHE_WORDS = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """A byte-level BPE in merge order: 0 to 255 are bytes, 256 + r is what merge r makes."""

    tokens: list[bytes]  # by merge order
    ids: np.ndarray  # by merge order: the file's id
    pair_slots: np.ndarray  # hash table of the merges' pairs, -1 where empty
    slot_made: np.ndarray
    merges: dict[int, int]  # left << 32 | right: what it makes
    left: np.ndarray
    right: np.ndarray
    special: dict[str, int]
    step: np.ndarray = None  # trie of the tokens that BPE gives for their own bytes: node, byte -> node, or 0
    found: np.ndarray = None  # the token that ends at a node, or -1
    decoded: np.ndarray = None  # bytes of all ids in a row, and where each ends
    decoded_ends: np.ndarray = None

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab, merges = byte_letters(), spec["model"]["vocab"], spec["model"]["merges"]
        raw = lambda s: bytes(letters[c] for c in s)
        tokens, index = [bytes([b]) for b in range(256)], {bytes([b]): b for b in range(256)}
        to_letter = {b: c for c, b in letters.items()}
        ids = [vocab[to_letter[b]] for b in range(256)]
        left, right, pairs = list(range(256)), list(range(256)), {}
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs[index[raw(a)] << 32 | index[raw(b)]] = len(tokens)
            left.append(index[raw(a)])
            right.append(index[raw(b)])
            index[raw(a + b)] = len(tokens)
            ids.append(vocab[a + b])
            tokens.append(raw(a + b))
        slots, made = _hash_table(pairs)
        self = cls(
            tokens=tokens, ids=np.array(ids, dtype=np.int32), merges=pairs, pair_slots=slots, slot_made=made,
            left=np.array(left, dtype=np.int64), right=np.array(right, dtype=np.int64), special={t["content"]: t["id"] for t in spec["added_tokens"]},
        )
        self.step, self.found = _trie({t: k for t, k in index.items() if k < 256 or self.merge(t) == [k]})
        decoded = dict(zip((int(i) for i in self.ids), tokens)) | {i: s.encode() for s, i in self.special.items()}
        sizes = [len(decoded.get(i, b"")) for i in range(max(decoded) + 1)]
        self.decoded = np.frombuffer(b"".join(decoded.get(i, b"") for i in range(len(sizes))), dtype=np.uint8)
        self.decoded_ends = np.cumsum([0, *sizes])
        return self

    def made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the merge of each pair makes; the number of tokens where there is none."""
        code = a << 32 | b
        at, mask = _slot(code), len(self.pair_slots) - 1
        got = self.pair_slots[at]
        out = np.where(got == code, self.slot_made[at], len(self.tokens))
        open_ = np.flatnonzero((got != code) & (got >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.pair_slots[at[open_]]
            hit = got == code[open_]
            out[open_[hit]] = self.slot_made[at[open_[hit]]]
            open_ = open_[~hit & (got >= 0)]
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: always the earliest merge, the leftmost of equals."""
        return self._merge_long(word) if len(word) > 64 else self._merge_short(word)

    def _merge_short(self, word: bytes) -> list[int]:
        at, never, rank = list(word), len(self.tokens), self.merges.get
        made = [rank(a << 32 | b, never) for a, b in zip(at, at[1:])]
        while made and (m := min(made)) < never:
            i = made.index(m)
            at[i] = m
            del at[i + 1], made[i]
            if i < len(made):
                made[i] = rank(m << 32 | at[i + 1], never)
            if i:
                made[i - 1] = rank(at[i - 1] << 32 | m, never)
        return at

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap and a linked list: n log n for words of any length."""
        at: list[int] = list(word)
        nxt, prv = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
        heap = [(m, i, at[i], at[i + 1]) for i in range(len(at) - 1) if (m := self.merges.get(at[i] << 32 | at[i + 1])) is not None]
        heapq.heapify(heap)
        n = len(at)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = nxt[i] if at[i] >= 0 else n
            if at[i] != a or j >= n or at[j] != b:
                continue
            at[i], at[j] = m, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (k := self.merges.get(m << 32 | at[nxt[i]])) is not None:
                    heapq.heappush(heap, (k, i, m, at[nxt[i]]))
            if prv[i] >= 0 and (k := self.merges.get(at[prv[i]] << 32 | m)) is not None:
                heapq.heappush(heap, (k, prv[i], at[prv[i]], m))
        return [x for x in at if x >= 0]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Exact BPE of many words of up to 64 bytes, one merge of each word at a time."""
        none, out = len(self.tokens), [[]] * len(words)
        size = np.array([len(w) for w in words], dtype=np.int64)
        width = int(size.max())
        at = np.full((len(words), width + 1), none, dtype=np.int64)
        at[:, :width][np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        rank = self.made(at[:, :-1].ravel(), at[:, 1:].ravel()).reshape(len(words), width)
        rows = np.arange(len(words))  # of the caller's list
        while len(rows):
            i = rank.argmin(axis=1)
            r = np.arange(len(rows))
            m = rank[r, i]
            done = m == none
            if done.any():
                for k, x in zip(rows[done].tolist(), at[done].tolist()):
                    out[k] = x[: x.index(none)]
                at, rank, rows, i, m = at[~done], rank[~done], rows[~done], i[~done], m[~done]
                r = np.arange(len(rows))
            at[r, i] = m
            after = np.arange(width)[None, :] > i[:, None]
            at[:, :-1] = np.where(after, at[:, 1:], at[:, :-1])
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[r, i] = self.made(m, at[r, i + 1])
            left = i > 0
            rank[r[left], i[left] - 1] = self.made(at[r[left], i[left] - 1], m[left])
        return out

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left, for all words at once: tokens in a row, and the word of each."""
        raw = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(w) for w in words])
        word, start = np.arange(len(words)), np.concatenate([[0], ends[:-1]])
        word, start = word[start < ends], start[start < ends]
        at, node, best, stop = start.copy(), np.zeros(len(start), dtype=np.int64), np.full(len(start), -1), start.copy()
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            node = np.where(at < ends[word], self.step[np.minimum(node, len(self.step) - 1), raw[at]], 0)
            at += 1
            token = self.found[node]
            longer = token >= 0
            best[longer], stop[longer] = token[longer], at[longer]
            dead = node == 0
            if dead.any():
                got.append((word[dead], start[dead], best[dead]))
                start[dead] = at[dead] = stop[dead]
                live = start < ends[word]
                if not live.all():
                    word, start, at, node, best, stop = (x[live] for x in (word, start, at, node, best, stop))
        words_, starts, tokens = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, dtype=np.int64),) * 3
        order = np.argsort(starts, kind="stable")
        return tokens[order], words_[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the border between tokens a and b alone, for all pairs at once.

        The merges of both tokens are undone from the last one backwards; at
        each step a merge across the border that comes before the step's own
        would have been made first, and the pair fails.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, open_ = np.zeros(len(a), dtype=bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(open_):
            made = self.made(a, b)
            fails = (made < len(self.tokens)) & (made < limit)
            a, b, limit, open_ = a[~fails], b[~fails], limit[~fails], open_[~fails]
            over_a = a > b
            part_a, part_b = self.right[a], self.left[b]
            stuck = np.where(over_a, part_a == a, part_b == b)  # the later token is a byte: undo the other one
            done = stuck & np.where(over_a, part_b == b, part_a == a)
            undo_a = over_a ^ stuck
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, part_a, a), np.where(undo_a, b, part_b)
            good[open_[done]] = True
            a, b, limit, open_ = a[~done], b[~done], limit[~done], open_[~done]
        return good

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """Ids of each word as int32 bytes, and how many words needed exact merging."""
        flat, owner = self.greedy(words)
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        bad = np.unique(owner[:-1][inner][~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]).tolist() if len(pairs) else []
        ends = np.searchsorted(owner, np.arange(len(words) + 1)) * 4
        ids = self.ids[flat].tobytes()
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        by_width: dict[int, list[int]] = {}
        for i in bad:
            by_width.setdefault((len(words[i]) + 7) // 8, []).append(i)
        for width, some in by_width.items():
            exact = [self.merge(words[i]) for i in some] if width > 8 else self.merge_all([words[i] for i in some])
            for i, x in zip(some, exact):
                out[i] = self.ids[x].tobytes()
        return out, len(bad)


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _hash_table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing over 2**20 slots."""
    slots, made = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=np.int64)
    for (code, m), at in zip(pairs.items(), _slot(np.array(list(pairs), dtype=np.int64)).tolist()):
        while slots[at] >= 0:
            at = (at + 1) & 0xFFFFF
        slots[at], made[at] = code, m
    return slots, made


def _trie(tokens: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with children come first, so that the table has no rows for leaves but one, which is empty."""
    inner = sorted({t[:j] for t in tokens for j in range(len(t))}, key=len)
    node = {p: i for i, p in enumerate(inner)}
    leaf = [t for t in tokens if t not in node]
    node |= {t: len(inner) + i for i, t in enumerate(leaf)}
    step = np.zeros((len(node), 256), dtype=np.int32) if len(leaf) < 256 else np.zeros((len(inner) + 1, 256), dtype=np.int32)
    found = np.full(len(node), -1, dtype=np.int64)
    for t, k in tokens.items():
        found[node[t]] = k
    for p, i in node.items():
        if p:
            step[node[p[:-1]], p[-1]] = i
    return step, found


class Encoder:
    """Texts to ids and back, with a bounded memory of words."""

    def __init__(self, path: str):
        self.vocab = Vocabulary.load(path)
        self.words: dict[str, bytes] = {}
        s = [regex.escape(x) for x in sorted(self.vocab.special, key=len, reverse=True)]
        self.special = regex.compile(f"({'|'.join(s)})") if s else None

    def split(self, text: str) -> list[str]:
        """Words that no merge crosses; texts of special tokens stand alone."""
        def plain(t: str) -> list[str]:
            if t.isascii() or not _HIGH.search(t):
                return _WORDS_LOW.findall(t)
            return (_WORDS_LATE if _HAS_LATE.search(t) else _WORDS).findall(t)

        if self.special and any(s in text for s in self.vocab.special):
            return [w for k, t in enumerate(self.special.split(text)) for w in ([t] if k % 2 else plain(t))]
        return plain(text)

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """For each text its ids as int32 bytes."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        split, known = [self.split(t) for t in batch], self.words
        fresh = set(chain.from_iterable(split)).difference(known)
        for w in fresh & self.vocab.special.keys():
            known[w] = np.int32(self.vocab.special[w]).tobytes()
        plain = [*fresh.difference(self.vocab.special)]
        for i in range(0, len(plain), 50_000):
            part = plain[i : i + 50_000]
            known.update(zip(part, self.vocab.encode_words([w.encode() for w in part])[0]))
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode_batch(self, lists: list[bytes]) -> list[str]:
        """Ids back to text; bytes that aren't UTF-8 become U+FFFD."""
        ends, out = self.vocab.decoded_ends, []
        for x in lists:
            ids = np.frombuffer(x, dtype=np.int32)
            sizes = ends[ids + 1] - ends[ids]
            stops = np.cumsum(sizes)
            at = np.arange(stops[-1] if len(ids) else 0) + np.repeat(ends[ids] - (stops - sizes), sizes)
            out.append(self.vocab.decoded[at].tobytes().decode("utf-8", "replace"))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Add ``ids array<int>`` and ``decoded string`` to every row.

    ``tokenizer`` is the path of a byte-level BPE file on each node (by
    default the public 50k vocabulary). Special tokens' strings in a text give
    their special ids, as in the library's ``encode(add_special_tokens=False)``.
    Null and empty texts give no ids and an empty text; rows repeat as they
    come; an empty table stays empty; columns named ``ids`` or ``decoded`` are
    replaced. No shuffle; memory is one Arrow batch and a bounded word cache.
    """
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        enc = encoder(tokenizer or default_path())
        ids = enc.encode_batch(texts(batch, text_col))
        return [int_lists(ids), pa.array(enc.decode_batch(ids), type=pa.string())]

    return add_columns(docs, run, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8: token counts and digests of ids and decoded texts."""
    out = encode_decode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
