"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word sums over all its segmentations into pieces (forward
algorithm); a text is scored by the product over its words.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.session import prepare, read_table

from ._rows import add_columns, texts

#: Distinct texts of each language that the classifier is fitted on, whatever their length.
FIT_TEXTS = 150
EM_ROUNDS = 3
#: Edges times languages that EM holds at once; a word that has more goes alone.
EM_CELLS = 1 << 18
UNDETERMINED = "und"
#: Distinct words that a worker remembers; beyond, it starts afresh.
CACHE_WORDS = 300_000
#: Words times the letters of the longest that are walked at once.
WALK_LETTERS = 200_000
_LETTERS = regex.compile(r"\p{L}+")
_START = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters; controls and single bytes are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p.lower() for p in own if _LETTERS.fullmatch(p.removeprefix(_START) or "a")})


def words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _LETTERS.findall(text.lower())


@dataclass
class Model:
    """Piece probabilities by language; any other letter is an unknown piece of its own."""

    languages: list[str]
    pieces: dict[str, int]
    prob: np.ndarray  # pieces x languages
    unknown: np.ndarray  # of one letter that is no piece, by language

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        self.memory: dict[str, int] = {}
        self.step = None  # what scoring alone needs is made by the first scoring

    def _trie(self) -> None:
        """The pieces as a table: node and character to node. Node 0 is dead, node 1 the root, character 0 any other."""
        chars = sorted({c for p in self.pieces for c in p if len(p) > 1} | {_START})
        self.chars = np.zeros(0x110000, dtype=np.int16)
        self.chars[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        nodes = {"": 1} | {p: k + 2 for k, p in enumerate(sorted({p[:j] for p in self.pieces if len(p) > 1 for j in range(1, len(p) + 1)} | set(chars)))}
        self.step = np.zeros((len(nodes) + 1, len(chars) + 1), dtype=np.int32)
        self.node_prob = np.zeros((len(nodes) + 1, len(self.languages)))
        for p, k in nodes.items():
            if p:
                self.step[nodes[p[:-1]], self.chars[ord(p[-1])]] = k
                if p in self.pieces:
                    self.node_prob[k] = self.prob[self.pieces[p]]
                elif len(p) == 1:
                    self.node_prob[k] = self.unknown
        self.scores = np.zeros((CACHE_WORDS, len(self.languages)))
        # letters that stand in no longer piece: pieces of their own, or unknown
        self.single = {ord(p): self.prob[k] for p, k in self.pieces.items() if len(p) == 1 and p not in chars}

    def lattice(self, word: str) -> list[tuple[int, int, int]]:
        """All (start, end, piece) of a word; piece -1 is an unknown letter."""
        w, get, out = _START + word, self.pieces.get, []
        for i in range(len(w)):
            single = False
            for j in range(i + 1, min(len(w), i + self.longest) + 1):
                if (k := get(w[i:j])) is not None:
                    out.append((i, j, k))
                    single |= j == i + 1
            if not single:
                out.append((i, i + 1, -1))
        return out

    def word_scores(self, fresh: list[str]) -> np.ndarray:
        """Log-probability of each word in each language: the forward algorithm on many words at once.

        From every start position the trie is walked as far as any word goes,
        and each piece on the way adds to the forward value at its end. Now and
        then the values are scaled, so that long words don't underflow.
        """
        if self.step is None:
            self._trie()
        n, langs = len(fresh), len(self.languages)
        size = np.array([len(w) + 1 for w in fresh])
        width = int(size.max())
        code = np.zeros((n, width), dtype=np.uint32)
        code[np.arange(width) < size[:, None]] = np.frombuffer("".join(_START + w for w in fresh).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        char, logs = self.chars[code], np.zeros((n, langs))
        alpha = np.zeros((width + self.longest + 1, n, langs))
        alpha[0] = 1
        for i in range(width):
            if i % 8 == 7:
                top = alpha[i : i + self.longest + 1].max(axis=0)
                top[(size < i) | (top == 0).any(axis=1)] = 1
                alpha[i : i + self.longest + 1] /= top
                logs += np.log(top)
            node = np.ones(n, dtype=np.int32)
            for j in range(i, min(width, i + self.longest)):
                node = self.step[node, char[:, j]]
                live = np.flatnonzero(node)
                if not len(live):
                    break
                alpha[j + 1, live] += alpha[i, live] * self.node_prob[node[live]]
            other = np.flatnonzero((char[:, i] == 0) & (i < size))
            for k in other.tolist():
                alpha[i + 1, k] += alpha[i, k] * self.single.get(int(code[k, i]), self.unknown)
        return np.log(alpha[size, np.arange(n)]) + logs

    def text_scores(self, batch: list[str]) -> list[np.ndarray | None]:
        """Log-probability of each text in each language; None without a letter."""
        if self.step is None:
            self._trie()
        split = [words(t) for t in batch]
        fresh = [*{w for ws in split for w in ws}.difference(self.memory)]
        if len(self.memory) + len(fresh) > CACHE_WORDS:
            self.memory.clear()
            fresh = [*{w for ws in split for w in ws}]
        if len(fresh) > len(self.scores):
            self.scores = np.zeros((len(fresh), len(self.languages)))
        fresh.sort(key=len)
        i = 0
        while i < len(fresh):
            part = fresh[i : i + 2000]
            while len(part) > 1 and len(part) * len(part[-1]) > WALK_LETTERS:  # few long words at once
                part = part[: len(part) // 2]
            n = len(self.memory)
            self.scores[n : n + len(part)] = self.word_scores(part)
            self.memory.update(zip(part, range(n, n + len(part))))
            i += len(part)
        get = self.memory.__getitem__
        return [self.scores[np.fromiter(map(get, ws), dtype=np.int64, count=len(ws))].sum(axis=0) if ws else None for ws in split]

    def predict(self, batch: list[str]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior under equal priors."""
        out = []
        for s in self.text_scores(batch):
            if s is None or not self.languages:
                out.append((UNDETERMINED, 0.0))
            else:
                k = int(s.argmax())
                out.append((self.languages[k], float(1 / np.exp(s - s[k]).sum())))
        return out


def _steps(place: np.ndarray) -> list[np.ndarray]:
    """Edges by their place in the word, the first place first."""
    order = np.argsort(place, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(place[order])) + 1)


def train(counts: list[tuple[str, str, int]], pieces: list[str], rounds: int = EM_ROUNDS, smooth: float = 0.05) -> Model:
    """Piece probabilities from (language, word, count) by EM over all segmentations.

    Words go by blocks of ``EM_CELLS`` edges times languages, in one order
    whatever the blocks, so that sums are the same to the last bit and memory
    is 12 bytes an edge, besides a block's.
    """
    languages = sorted({c[0] for c in counts})
    index, place = {p: i for i, p in enumerate(pieces)}, {lang: i for i, lang in enumerate(languages)}
    v, n = len(pieces), len(languages)
    model = Model(languages, index, np.full((v, n), 1 / (v + 1)), np.full(n, 1 / (v + 1) / 1000))
    fitted = sorted({c[1] for c in counts})
    if not fitted:
        return model
    number = {w: k for k, w in enumerate(fitted)}
    teaches = np.fromiter((number[c[1]] for c in counts), np.int64, len(counts))
    order = np.argsort(teaches, kind="stable")
    teaches = teaches[order]
    column = np.fromiter((place[c[0]] for c in counts), np.int64, len(counts))[order]
    times = np.fromiter((c[2] for c in counts), np.float64, len(counts))[order]
    flat, stop = array("i"), np.zeros(len(fitted) + 1, dtype=np.int64)
    for k, w in enumerate(fitted):
        flat.extend(chain.from_iterable(model.lattice(w)))
        stop[k + 1] = len(flat) // 3
    edges = np.frombuffer(flat, dtype=np.int32).reshape(-1, 3)
    size = np.array([len(w) + 1 for w in fitted])
    blocks = [0]
    while blocks[-1] < len(fitted):
        blocks.append(max(blocks[-1] + 1, int(np.searchsorted(stop, stop[blocks[-1]] + max(1, EM_CELLS // n), "right")) - 1))

    def expect(low: int, high: int, logp: np.ndarray, total: np.ndarray) -> None:
        """Add what the words from low to high are expected to hold of each piece."""
        start, end, piece = edges[stop[low] : stop[high]].T.astype(np.int64)
        piece[piece < 0] = v  # the last row: unknown letters
        who = np.repeat(np.arange(high - low), np.diff(stop[low : high + 1]))
        own = slice(*np.searchsorted(teaches, [low, high]))
        weight = np.zeros((high - low, n))
        np.add.at(weight, (teaches[own] - low, column[own]), times[own])
        base = np.concatenate([[0], np.cumsum(size[low:high] + 1)])
        at, to = base[who] + start, base[who] + end
        # sums of products as logarithms, so that words of any length have their place
        logs = logp[piece]
        f, b = np.full((base[-1], n), -np.inf), np.full((base[-1], n), -np.inf)
        f[base[:-1]] = b[base[1:] - 1] = 0
        for ix in _steps(end):
            np.logaddexp.at(f, to[ix], f[at[ix]] + logs[ix])
        for ix in _steps(start)[::-1]:
            np.logaddexp.at(b, at[ix], b[to[ix]] + logs[ix])
        logs += f[at]
        logs += b[to]
        logs -= f[base[1:] - 1][who]
        np.add.at(total, piece, np.exp(logs) * weight[who])

    p = np.vstack([model.prob, model.unknown])
    for _ in range(rounds):
        logp, total = np.log(p), np.full((v + 1, n), smooth)
        for low, high in pairwise(blocks):
            expect(low, high, logp, total)
        p = total / total.sum(axis=0)
        # an unknown letter is one of many: its mass is spread over an alphabet's worth of letters
        p[v] /= 100
    return Model(languages, index, p[:v], p[v])


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> F.Column:
    """Whether a document is kept out of fitting; a null id is fitted on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_TEXTS, vocabulary: str | None = None) -> Model:
    """Fit on about ``per_language`` distinct labelled texts of each language, or on all if there are fewer.

    The sample is what a hash of the text puts first, at the share that the
    count of distinct texts asks for, and one text at least; their length
    doesn't matter, copies count once. Rows with null text or null language
    teach nothing. Words are counted where the texts are, by the rule that
    prediction uses; the driver gets the counts of the bounded sample.
    """
    hashed = F.pmod(F.xxhash64("t"), F.lit(1 << 40))
    labelled = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull())
    stats = labelled.select("l", hashed.alias("h")).distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    pick = F.lit(False)
    for r in sorted(stats.collect(), key=lambda r: r.l):
        pick = pick | ((F.col("l") == r.l) & (hashed <= max(r.least, math.ceil(min(1.0, per_language / r.n) * (1 << 40)))))
    sample = labelled.where(pick).dropDuplicates(["l", "t"]).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, t in zip(b.column(0).to_pylist(), texts(b, "t")):
                seen.update((lang, w) for w in words(t))
            if seen:
                langs, found = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array([*seen.values()], pa.int64())], names=["l", "w", "c"])

    prepare(docs.sparkSession)
    counts = sample.mapInArrow(count, "l string, w string, c long").groupBy("l", "w").agg(F.sum("c").alias("c"))
    return train(sorted((r.l, r.w, r.c) for r in counts.collect()), load_pieces(vocabulary or default_path()))


_MODEL: list = []


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred string`` and ``score double``, the posterior of that language.

    Texts that are null or have no letter get ``und`` and 0, as all texts do
    if the model has learned no language. Equal posteriors go to the language
    that sorts first. Only the text is looked at. Columns of these names are
    replaced; rows repeat as they come; an empty table stays empty. No
    shuffle; the model is broadcast (32,000 pieces times the languages).
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.prob, model.unknown))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        if not _MODEL or _MODEL[0] is not shipped.value:
            _MODEL[:] = [shipped.value, Model(*shipped.value)]
        got = _MODEL[1].predict(texts(batch, text_col))
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

    return add_columns(docs, run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10: fitted on three quarters, predicted for all documents."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
