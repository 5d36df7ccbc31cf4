"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Frequent words are classes of their own; the others share classes by their last
letters, and within such a class a word has its add-one share, one unseen word
included. The model predicts a class from the three before it: the context vector
is the sum of the context classes' vectors, scaled by position. It predicts in
two levels, a group of classes and then the class in its group, each scored by
inner product with the context vector plus a bias. Normalisers come from batched
matrix products over the groups and over the members of one group, so the token
log-probabilities are normalised exactly.

Texts are dealt to rounds and shards by a hash of their rows. In each round every
shard trains on all its texts, in the order of the hash, from one common start,
and the parameters are averaged by token counts. Rounds and shards depend on the
rows alone, so the model doesn't change with the partitions that they come in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.scratch import materialize
from millrace.core.session import prepare, read_table

from ._rows import texts
from ._words import Q, blocks, hash_words, mix

#: Words with a class of their own (the end of a text is one), and shared classes.
OWN, SHARED = 3072, 1024
CLASSES = OWN + SHARED
#: Groups of classes, and classes in each.
GROUPS = 64
MEMBERS = CLASSES // GROUPS
DIM, CONTEXT, RATE = 16, 3, 0.1
#: Noise drawn for a step: groups, and members of each group.
NOISE_GROUPS, NOISE_MEMBERS = 8, 8
#: Tokens of a step: at most, and such that a pass over a small corpus has about so many steps.
BATCH, STEPS = 16_384, 256
#: Rounds after each of which parameters are averaged; each text is trained on in one of them.
ROUNDS = 2
#: Tokens of a shard, and most shards (beyond, shards grow with the corpus).
SHARD_TOKENS, SHARDS = 1 << 21, 4096
#: Words whose counts are broadcast; those of all others are joined.
HEAD = 1 << 18
#: The hash that stands for the end of a text.
END = np.uint64(0xE17D)


def _tokens(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of texts: token hashes, the shared class of each, and tokens up to each text's end."""
    for block in blocks(batch):
        w = hash_words(block)
        tail = np.zeros(len(w.last), dtype=np.uint64)
        for back in (1, 2, 3):  # the last three bytes
            tail = tail << np.uint64(8) | np.where(w.last - w.first >= back, w.raw[np.maximum(w.last - back, 0)], 0).astype(np.uint64)
        shared = (mix(tail * np.uint64(Q) + np.uint64(1)) % np.uint64(SHARED)).astype(np.int64)
        at = w.ends
        yield np.insert(w.hashes, at, END), np.insert(shared, at, 0), at + np.arange(1, len(at) + 1)


class Lookup:
    """Hashes to positions in a sorted table, -1 where there is none."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.order[at], -1)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithms of the rows' sums of exponentials; ``x`` is used up. Only rows with large scores need a shift."""
    if x.max() < 60:
        return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], dtype=x.dtype))
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def _by_row(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their gradients."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(grads[order], first, axis=0)


_SHAPES = {"r": (CLASSES, DIM), "scale": (CONTEXT, DIM), "qg": (GROUPS, DIM), "bg": (GROUPS,), "q": (CLASSES, DIM), "b": (CLASSES,)}


#: What AdaGrad's sums of squares start from: biases, which start at the unigram, move slowly.
_SEEN = {"r": 1.0, "scale": 100.0, "qg": 1.0, "bg": 1000.0, "q": 1.0, "b": 100.0}


@dataclass
class Params:
    """Vectors of context classes, scales by position; vectors and biases of groups and of their members.

    A class is a number: its group times ``MEMBERS`` plus its place in the group.
    """

    r: np.ndarray
    scale: np.ndarray
    qg: np.ndarray
    bg: np.ndarray
    q: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 11) -> Params:
        """Small vectors, and the biases that make the model one of unigrams."""
        rng = np.random.default_rng(seed)
        some = lambda name: rng.normal(0, 0.1, _SHAPES[name]).astype(np.float32)
        groups = unigram.reshape(GROUPS, MEMBERS).sum(axis=1)
        b = np.log(unigram) - np.repeat(np.log(groups), MEMBERS)
        return cls(some("r"), np.ones(_SHAPES["scale"], dtype=np.float32), some("qg"), np.log(groups).astype(np.float32), some("q"), b.astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in _SHAPES])

    @classmethod
    def of(cls, x: np.ndarray) -> Params:
        cuts = np.cumsum([int(np.prod(s)) for s in _SHAPES.values()])[:-1]
        return cls(*(part.reshape(s).astype(np.float32) for part, s in zip(np.split(x, cuts), _SHAPES.values())))

    def context(self, w: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Context vectors of consecutive tokens, and their vectors ``k`` places before (zero before a text)."""
        e = self.r[w]
        ctx, shifted = np.zeros_like(e), []
        for k in range(1, CONTEXT + 1):
            back = np.empty_like(e)
            back[:k], back[k:] = 0, e[:-k]
            back[np.flatnonzero(place < k)] = 0
            shifted.append(back)
            ctx += back * self.scale[k - 1]
        return ctx, shifted

    def log_probs(self, w: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural log-probability of each of some consecutive tokens' classes."""
        ctx, _ = self.context(w, place)
        group = w // MEMBERS
        level = ctx @ self.qg.T + self.bg
        out = level[np.arange(len(w)), group].astype(np.float64)
        out -= _log_sum(level)
        for g, ix in _of_groups(group):
            level = ctx[ix] @ self.q[g * MEMBERS : (g + 1) * MEMBERS].T + self.b[g * MEMBERS : (g + 1) * MEMBERS]
            mine = level[np.arange(len(ix)), w[ix] % MEMBERS]
            out[ix] += mine - _log_sum(level)
        return out


def _of_groups(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group.astype(np.int16), kind="stable")
    edges = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        if edges[g] < edges[g + 1]:
            yield g, order[edges[g] : edges[g + 1]]


def _places(ends: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    sizes = np.diff(np.concatenate([[0], ends]))
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Trainer:
    """Noise-contrastive estimation at both levels, noise shared by a step, AdaGrad steps."""

    def __init__(self, start: Params, unigram: np.ndarray, seed: int):
        self.p, self.rng, self.tokens = Params(*(getattr(start, k).copy() for k in _SHAPES)), np.random.default_rng(seed), 0
        groups = unigram.reshape(GROUPS, MEMBERS).sum(axis=1)
        members = unigram.reshape(GROUPS, MEMBERS) / groups[:, None]
        self.group_noise, self.member_noise = np.log(groups * NOISE_GROUPS).astype(np.float32), np.log(members * NOISE_MEMBERS).astype(np.float32)
        self.groups, self.members = np.cumsum(groups), np.cumsum(members, axis=1)
        self.seen = {k: np.full(s, _SEEN[k], dtype=np.float32) for k, s in _SHAPES.items()}

    def noise(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups, and members of each group, drawn by their frequency."""
        drawn = np.searchsorted(self.groups, self.rng.random(NOISE_GROUPS), side="right")
        inside = (self.members[:, None, :] <= self.rng.random((GROUPS, NOISE_MEMBERS))[:, :, None]).sum(axis=2)
        return np.minimum(drawn, GROUPS - 1), np.minimum(inside, MEMBERS - 1)

    def _move(self, name: str, rows: np.ndarray | slice, grad: np.ndarray) -> None:
        s = self.seen[name]
        s[rows] += grad * grad
        getattr(self.p, name)[rows] += RATE * grad / np.sqrt(s[rows])

    @staticmethod
    def _pull(score: np.ndarray, log_noise: np.ndarray, true: bool) -> np.ndarray:
        """What the log-likelihood of telling data from noise asks of a score."""
        odds = 1 / (1 + np.exp(np.clip(log_noise - score, -30, 30)))  # that a class is data
        return (1 - odds if true else -odds).astype(np.float32)

    def step(self, w: np.ndarray, place: np.ndarray) -> None:
        p = self.p
        self.tokens += len(w)
        ctx, shifted = p.context(w, place)
        group = w // MEMBERS
        noise, drawn = self.noise()
        # which group
        to_group, to_word = p.qg[group], p.q[w]
        good = self._pull(np.einsum("ij,ij->i", ctx, to_group) + p.bg[group], self.group_noise[group], True)
        bad = self._pull(ctx @ p.qg[noise].T + p.bg[noise], self.group_noise[noise], False)
        d_ctx = good[:, None] * to_group + bad @ p.qg[noise]
        d_qg, d_bg = np.zeros_like(p.qg), np.bincount(group, good, GROUPS).astype(np.float32)
        np.add.at(d_qg, noise, bad.T @ ctx)
        np.add.at(d_bg, noise, bad.sum(0))
        # which member of it: the true one, then noise group by group
        right = self._pull(np.einsum("ij,ij->i", ctx, to_word) + p.b[w], self.member_noise[group, w - group * MEMBERS], True)
        d_ctx += right[:, None] * to_word
        order = np.argsort(group.astype(np.int16), kind="stable")
        c, good = ctx[order], good[order]
        edges, d_c = np.searchsorted(group[order], np.arange(GROUPS + 1)), np.empty_like(ctx)
        others, d_others = drawn + np.arange(GROUPS)[:, None] * MEMBERS, np.zeros((GROUPS, NOISE_MEMBERS, DIM + 1), dtype=np.float32)
        for g in np.flatnonzero(np.diff(edges)).tolist():
            at, q = slice(edges[g], edges[g + 1]), p.q[others[g]]
            x = c[at]
            d_qg[g] += good[at] @ x
            wrong = self._pull(x @ q.T + p.b[others[g]], self.member_noise[g, drawn[g]], False)
            d_c[at] = wrong @ q
            d_others[g, :, :DIM], d_others[g, :, DIM] = wrong.T @ x, wrong.sum(0)
        d_ctx[order] += d_c
        # back to the context words
        d_e = np.zeros_like(ctx)
        for k, back in enumerate(shifted, 1):
            pulled = d_ctx * p.scale[k - 1]
            pulled[np.flatnonzero(place < k)] = 0
            d_e[:-k] += pulled[k:]
        d_scale = np.stack([np.einsum("ij,ij->j", d_ctx, back) for back in shifted])
        seen, grads = _by_row(w, np.concatenate([d_e, right[:, None] * ctx, right[:, None]], axis=1))
        d_q, d_b = np.zeros_like(p.q), np.zeros_like(p.b)
        d_q[seen], d_b[seen] = grads[:, DIM : 2 * DIM], grads[:, 2 * DIM]
        np.add.at(d_q, others.ravel(), d_others[:, :, :DIM].reshape(-1, DIM))
        np.add.at(d_b, others.ravel(), d_others[:, :, DIM].ravel())
        for name, at, grad in (("r", seen, grads[:, :DIM]), ("scale", slice(None), d_scale), ("qg", slice(None), d_qg), ("bg", slice(None), d_bg), ("q", slice(None), d_q), ("b", slice(None), d_b)):
            self._move(name, at, grad)


@dataclass
class Model:
    own: np.ndarray  # hashes of the words that have a class; the first is the end
    number: np.ndarray  # of each class (words first, then shared ones): its group and place
    head: np.ndarray  # hashes and counts of the most frequent words
    head_counts: np.ndarray
    class_sums: np.ndarray  # of the shared classes: sum of c + 1 over their words, one unseen word included
    unigram: np.ndarray  # by number
    params: Params
    n: int
    v: int


def _class_of(own: Lookup, h: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Classes by rank: words with one of their own, then shared ones."""
    at = own(h)
    return np.where(at >= 0, at, OWN + shared)


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """Whether a document is kept out of training; a null id is trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def word_counts(train: DataFrame) -> DataFrame:
    """(h, shared, c) of every token of all training texts (one column, ``text``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, s = [], []
            for x, y, _ in _tokens(texts(b, "text")):
                h.append(x)
                s.append(y)
            if h:
                keys, first, n = np.unique(np.concatenate(h), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.concatenate(s)[first].astype(np.int32)), pa.array(n)], names=["h", "shared", "c"])

    return train.mapInArrow(run, "h long, shared int, c long").groupBy("h").agg(F.min("shared").alias("shared"), F.sum("c").alias("c"))


def _frequent(counts: DataFrame, most: int) -> list:
    """At most about ``most`` words, those over a count that a histogram of 8 steps an octave gives."""
    step = F.floor(F.log2(F.col("c")) * 8)
    rest, least = most, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.s):
        if r.n > rest:
            break
        rest, least = rest - r.n, r.s
    return [] if least is None else sorted(((r.c, r.h) for r in counts.where(step >= least).select("h", "c").collect()), reverse=True)


def untrained(counts: DataFrame) -> Model:
    """Classes, counts and the unigram model they make."""
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    head = _frequent(counts, HEAD) if n else []
    keys = np.array([h for _, h in head], dtype=np.int64).view(np.uint64)
    own = np.array([END, *[h for h in keys if h != END][: OWN - 1]], dtype=np.uint64)
    ids = counts.sparkSession.createDataFrame([(int(h),) for h in own.view(np.int64)], "h long")
    sums, mass = np.ones(SHARED), np.ones(CLASSES)
    for r in counts.join(F.broadcast(ids), "h", "left_anti").groupBy("shared").agg(F.sum(F.col("c") + 1).alias("s"), F.sum("c").alias("c")).collect():  # OWN rows are broadcast, SHARED come back
        sums[r.shared] += r.s
        mass[OWN + r.shared] += r.c
    known = dict(zip(keys.tolist(), (c for c, _ in head)))
    mass[: len(own)] += [known.get(int(h), 0) for h in own]
    number = np.empty(CLASSES, dtype=np.int64)
    number[np.argsort(-mass, kind="stable")] = np.arange(CLASSES)  # classes of like frequency make a group
    unigram = np.empty(CLASSES)
    unigram[number] = mass / mass.sum()
    return Model(own, number, keys, np.array([c for c, _ in head], dtype=np.float64), sums, unigram, Params.start(unigram), n or 0, v)


def encode(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """(row, rid, ids, n_tokens, known, base, inside, rare): what scoring needs of each text.

    ``row`` holds the columns ``keep``; ``ids`` are the tokens' classes, two
    bytes each; ``base`` and ``inside`` sum the logarithms of the frequent
    words' counts, of all and of those in shared classes; ``rare`` lists the
    other words.
    """
    shipped = prepare(docs.sparkSession).sparkContext.broadcast((model.own, model.number, model.head, model.head_counts, model.class_sums))
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("row")
    src = docs.select(row, F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    rare_type = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("own", T.BooleanType())]))
    kinds = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "known": T.LongType(), "base": T.DoubleType(), "inside": T.DoubleType(), "rare": rare_type}
    schema = T.StructType([src.schema["row"], src.schema["rid"], *(T.StructField(k, t) for k, t in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_hashes, number, head_hashes, head_counts, sums = shipped.value
        own, head, log_sums = Lookup(own_hashes), Lookup(head_hashes), np.log10(sums)
        for b in batches:
            ids, n, known, base, inside, rare, cuts = [], [], [], [], [], [], []
            for h, shared, ends in _tokens(texts(b, "text")):
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                w, at = _class_of(own, h, shared), head(h)
                log_c = np.where(at >= 0, np.log10(head_counts[np.maximum(at, 0)] + 1) if len(head_counts) else 0.0, 0.0)
                alone = w < OWN
                codes = number[w].astype("<u2")
                ids += [codes[x:y].tobytes() for x, y in zip(starts, ends)]
                n.append(ends - starts)
                known.append(np.add.reduceat((at >= 0).astype(np.int64), starts))
                base.append(np.add.reduceat(log_c, starts))
                inside.append(np.add.reduceat(np.where(alone, 0.0, log_c - log_sums[np.maximum(w - OWN, 0)]), starts))
                tail = np.flatnonzero(at < 0)
                rare.append(np.stack([h[tail].view(np.int64), alone[tail].astype(np.int64)], axis=1))
                cuts.append(np.searchsorted(tail, ends) - np.searchsorted(tail, starts))
            if not n:
                continue
            flat = np.concatenate(rare)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.concatenate(cuts))]).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(bool))], names=["h", "own"]),
            )
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), *(pa.array(np.concatenate(x)) for x in (n, known, base, inside)), lists], names=schema.names)

    return materialize(src.mapInArrow(run, schema), "lm-encoded")


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), dtype="<u2").astype(np.int64), np.cumsum([len(x) // 2 for x in ids], dtype=np.int64)


def train(texts_: DataFrame, model: Model) -> Model:
    """The model trained on encoded texts: ``order long`` (a hash of the row) and ``ids binary``."""
    if not model.n:
        return model
    spark = texts_.sparkSession
    each = model.n // ROUNDS + 1
    shards = int(min(SHARDS, -(-each // SHARD_TOKENS)))
    batch = int(min(BATCH, max(256, min(each, SHARD_TOKENS) // STEPS)))
    shard = F.pmod("order", F.lit(shards)).cast("int").alias("shard")
    params = model.params
    for turn in range(ROUNDS):
        mine = texts_.where(F.pmod(F.shiftrightunsigned("order", 32), F.lit(ROUNDS)) == turn).select(shard, "order", "ids")
        dealt = mine.repartition(shards, "shard").sortWithinPartitions("shard", "order").select("shard", "ids")
        shipped = spark.sparkContext.broadcast((params, model.unigram))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            start, unigram = shipped.value
            t, now, held, size = None, None, [], 0

            def learn() -> None:
                w, ends = _joined(held)
                place = _places(ends)
                for i in range(0, len(w), batch):
                    t.step(w[i : i + batch], place[i : i + batch] if i == 0 else np.minimum(place[i : i + batch], np.arange(len(w[i : i + batch]))))
                held.clear()

            def done() -> pa.RecordBatch:
                x = t.p.flat().astype(np.float64)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x * t.tokens), pa.array(np.full(len(x), float(t.tokens)))], names=["k", "x", "w"])

            for b in batches:
                for shard, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if shard != now:
                        if t:
                            learn()
                            yield done()
                        t, now, size = Trainer(start, unigram, seed=1000 * turn + shard), shard, 0
                    held.append(ids)
                    size += len(ids) // 2
                    if size >= 4 * batch:
                        learn()
                        size = 0
            if t:
                learn()
                yield done()

        mean = dealt.mapInArrow(run, "k int, x double, w double").groupBy("k").agg((F.sum("x") / F.sum("w")).alias("x")).collect()
        if mean:  # few texts may all be in the other rounds
            params = Params.of(np.array([r.x for r in sorted(mean, key=lambda r: r.k)]))
    return Model(**{**model.__dict__, "params": params})


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model trained on all texts of ``docs``, and their word counts."""
    text = docs.select(F.col(text_col).alias("text"))
    prepare(docs.sparkSession)
    counts = materialize(word_counts(text), "lm-counts")
    model = untrained(counts)
    coded = encode(docs.select(text_col, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("order")), model, ["order"], text_col)
    return train(coded.select("row.order", "ids"), model), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", coded: DataFrame | None = None) -> DataFrame:
    """Add ``n_tokens, n_known, train_tokens long`` and ``base_score, score double``.

    ``score`` is the model's log10 probability of the whole text, its end
    included; ``base_score`` that of add-one unigrams. Null texts are empty:
    one token, the end. Rows repeat as they come; an empty table stays empty;
    columns of these names are replaced. Counts of frequent words are broadcast
    (``HEAD`` words at most); the others' are joined on the word. ``coded`` are
    rows that ``encode`` has made already; their ``row`` has the columns that pass.
    """
    names = {"n_tokens", "n_known", "train_tokens", "base_score", "score"}
    if coded is None:
        coded = encode(docs, model, [c for c in docs.columns if c.lower() not in names], text_col)
    keep = [c for c in coded.schema["row"].dataType.names if c != "_"]
    shipped = docs.sparkSession.sparkContext.broadcast(model.params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lm, i = b.column(1).to_pylist(), [], 0
            while i < len(ids):  # whole texts, about BATCH tokens at a time
                j, size = i, 0
                while j < len(ids) and (j == i or size < BATCH):
                    size += len(ids[j]) // 2
                    j += 1
                w, ends = _joined(ids[i:j])
                place, found = _places(ends), np.empty(len(w))
                for k in range(0, len(w), 4 * BATCH):  # a long text in parts, with the tokens before each
                    first = max(0, k - CONTEXT)
                    part = slice(first, k + 4 * BATCH)
                    found[k : k + 4 * BATCH] = shipped.value.log_probs(w[part], place[part])[k - first :]
                lm.append(np.add.reduceat(found, np.concatenate([[0], ends[:-1]])) / np.log(10))
                i = j
            if lm:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(lm))], names=["rid", "lm"])

    # a text's rare words are counted where they are, before they are dealt by word
    tail = coded.select("rid", F.explode("rare").alias("t")).select("rid", "t.h", "t.own").groupBy("rid", "h").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("own"))
    hit = tail.join(counts.select("h", "c"), "h")
    log_c = F.col("k") * F.log10(F.col("c") + 1)
    hit = hit.groupBy("rid").agg(F.sum("k").alias("k"), F.sum(log_c).alias("base2"), F.sum(F.when(~F.col("own"), log_c).otherwise(0.0)).alias("inside2"))
    out = coded.drop("rare", "ids").join(coded.select("rid", "ids").mapInArrow(run, "rid long, lm double"), "rid").join(hit, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = float(np.log10(model.n + model.v + 1))
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in keep), "n_tokens", (F.col("known") + zero("k")).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2") - F.col("n_tokens") * total).alias("base_score"), (F.col("lm") + F.col("inside") + zero("inside2")).alias("score"),
    )


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2: learn from six of seven parts, score all documents; each text is encoded once."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    counts = materialize(word_counts(docs.where("NOT held_out").select("text")), "lm-counts")
    model = untrained(counts)
    coded = encode(docs.withColumn("order", F.xxhash64("doc_id", "text")), model, ["doc_id", "held_out", "order"])
    model = train(coded.where("NOT row.held_out").select("row.order", "ids"), model)
    return score(docs, model, counts, coded=coded).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
