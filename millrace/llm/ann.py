"""Approximate nearest neighbours by inner product: adaptive dimension scan.

Vectors are rotated at random, so that a distance over the first d of D
dimensions estimates the whole. They are dealt to inverted lists by nearest
centroid and kept there in blocks, rotated once (in single precision, beside the
original). A query scans the blocks of the lists it probes a column block at a
time; after each, a hypothesis test abandons the candidates whose partial
distance is too large for the query's bound. What is left is scored in double
precision on the original vectors. The most promising
lists are scanned first, and what they give is the bound for the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.scratch import materialize
from millrace.core.session import prepare, read_table

#: Vectors that centroids, probes and the first bounds are fitted on: at least, and so many numbers at most
#: (2^22: 65,536 vectors of 64 dimensions); between, as many as the lists ask for, which grow with the root of the corpus.
FIT_VECTORS, FIT_NUMBERS, FIT_QUERIES, ANCHORS = 8192, 1 << 22, 512, 2048
#: Vectors of the sample that a list needs.
PER_LIST = 8
#: Share of true neighbours that the probes must reach on the sample.
PROBE_RECALL = 0.97
#: The test abandons if the partial distance is over (1 + EPSILON / sqrt(d)) times its share.
EPSILON = 2.4
COLUMNS = 16
BLOCK, QUERY_BLOCK = 2048, 512
#: Queries whose pairs with a block are held at once, and the share of live pairs below which they are gathered.
TILE, DENSE = 64, 1 / 16
#: Lists that are scanned first.
FIRST = 2


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    probes: int
    anchors: np.ndarray  # original vectors of the corpus
    anchor_ids: np.ndarray


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        total, n = np.zeros_like(c), np.bincount(at, minlength=k)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
    return np.where(np.isnan(d), np.inf, d).argmin(axis=1)


def _by_promise(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Lists in the order in which a query should probe them."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.argsort(-(q @ c.T), axis=1, kind="stable")


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)  # all others count in double precision
    return df.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<float>" if single else "array<double>").alias("v"))


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    """Vectors of an Arrow column as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of numbers as an Arrow column of single-precision lists; what is beyond their range is infinite."""
    with np.errstate(over="ignore"):
        flat = x.astype(np.float32).ravel()
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(flat))


def fit(vectors: DataFrame, n: int, dim: int, k: int, seed: int = 7, anchors: int = ANCHORS) -> Index:
    """Fit on a bounded sample: the vectors that a hash of the id puts first at the share asked for."""
    most = max(1, FIT_NUMBERS // max(1, dim))
    wanted = int(min(most, max(FIT_VECTORS, PER_LIST * np.sqrt(n) / 3)))
    share = min(1.0, wanted / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect()
    x = np.array([r.v for r in rows], dtype=np.float64).reshape(len(rows), dim)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    y = x @ rotation
    lists = int(min(max(1, np.sqrt(n) / 3), max(1, len(x) // PER_LIST)))
    c = _kmeans(y, lists, rng)
    # lists that must be probed so that the sample's true neighbours are reached
    q = y[:FIT_QUERIES]
    score = q @ y.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    # of the k nearest in all vectors, the sample holds its share
    near = np.argsort(-score, axis=1)[:, : max(1, min(int(np.ceil(k * len(y) / max(1, n))), len(y) - 1))]
    place = np.argsort(_by_promise(q, c), axis=1)[np.arange(len(q))[:, None], _nearest(y, c)[near]]
    probes = int(np.quantile(place, PROBE_RECALL)) + 1
    return Index(rotation, c, probes, x[:anchors], np.array([r.vec_id for r in rows[:anchors]], dtype=np.int64))


def _survivors(q: np.ndarray, rq: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, x: np.ndarray, rx: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons, by query."""
    dim = x.shape[1]
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    # an inner product of at least ``bound`` is a squared distance of at most ``most``
    most = qq[:, None] + xx[None, :] - 2 * bound[:, None] + 1e-5 * (qq[:, None] + xx[None, :])
    allowed = lambda b: ((1 + EPSILON / np.sqrt(b)) ** 2 if b < dim else 1) * (b / dim)
    live = ~(most < 0) & (q_ids[:, None] != ids[None, :])
    part = np.zeros(live.shape)
    for a in range(0, dim, COLUMNS):
        b = min(dim, a + COLUMNS)
        if a and np.count_nonzero(live) < DENSE * live.size:
            break
        part += (rq[:, a:b] ** 2).sum(1)[:, None] + (rx[:, a:b] ** 2).sum(1)[None, :] - 2 * rq[:, a:b] @ rx[:, a:b].T
        live &= ~(part > allowed(b) * most + 1e-9)
    else:
        return np.nonzero(live)
    i, j = np.nonzero(live)
    part, most = part[i, j], most[i, j]
    for a in range(a, dim, COLUMNS):
        b = min(dim, a + COLUMNS)
        part = part + ((rq[i, a:b] - rx[j, a:b]) ** 2).sum(1)
        ok = ~(part > allowed(b) * most + 1e-9)
        i, j, part, most = i[ok], j[ok], part[ok], most[ok]
    return i, j


def scan(q: np.ndarray, rq: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, x: np.ndarray, rx: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of a block for each query that may beat its bound: (query, candidate, score).

    ``rq`` and ``rx`` are the rotated vectors; their rounding is allowed for.
    Tests are put so that what isn't a number (a square out of range) passes.
    Column blocks are matrix products over all pairs of a tile while the tests
    leave many of them, and are gathered pair by pair once they leave few.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        tiles = [_survivors(q[s : s + TILE], rq[s : s + TILE], q_ids[s : s + TILE], bound[s : s + TILE], x, rx, ids) for s in range(0, len(q), TILE)]
        i = np.concatenate([t[0] + s for t, s in zip(tiles, range(0, len(q), TILE))])
        j = np.concatenate([t[1] for t in tiles])
        score = np.einsum("ij,ij->i", q[i], x[j])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    return q_ids[i[top]], ids[j[top]], score[top]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", anchors: int = ANCHORS) -> DataFrame:
    """The ``k`` vectors of largest inner product with each query, nearest first.

    Returns ``query_id long, rank int, vec_id long, score double``; ties go to
    the smaller id; a query's own row is no candidate; with fewer candidates a
    query gets them all. Vectors that are null, zero, of another than the usual
    length or with a null or non-finite component take no part, nor do rows
    with a null id; a query id that repeats counts once, and so do equal pairs;
    an empty table on either side gives no rows; other columns don't matter.
    Vectors of floats are scored as the doubles they are, all others as doubles.

    Every vector is in the index. Hot lists are split into blocks, and each
    query meets each block of a probed list once; only its best k go on.
    """
    spark = prepare(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    all_ = _usable(vectors, id_col, vec_col)
    sizes = all_.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", "))))
    dim, n = sizes[0].d, sizes[0].n
    all_ = all_.where(F.size("v") == dim)
    asks = _usable(queries, id_col, vec_col).where(F.size("v") == dim).dropDuplicates(["vec_id"])
    index = fit(all_, n, dim, k, anchors=anchors)
    number = all_.schema["v"].dataType.elementType.typeName()
    shipped = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        for b in batches:
            r = _numbers(b.column(1), b.num_rows) @ ix.rotation
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(r), pa.array(_nearest(r, ix.centroids).astype(np.int32))], names=["vec_id", "v", "r", "list"])

    def bounds(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each query's best k among the anchors, flat: query, anchor, score; and the k-th score, its bound."""
        ix = shipped.value
        x, own = _numbers(b.column(1), b.num_rows), b.column(0).to_numpy()
        bound, some = np.full(len(x), -1e300), min(len(ix.anchors), 2 * k + 2)
        if not some:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), bound
        rough = x @ ix.anchors.T
        rough[own[:, None] == ix.anchor_ids[None, :]] = -np.inf
        j = np.argpartition(-rough, some - 1, axis=1)[:, :some].ravel()  # a few more than k, then scored one by one
        i = np.repeat(np.arange(len(x)), some)
        other = own[i] != ix.anchor_ids[j]
        i, j = i[other], j[other]
        s = np.einsum("ij,ij->i", x[i], ix.anchors[j])
        order = np.lexsort((ix.anchor_ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        bound[i[place == k - 1]] = s[place == k - 1]
        return i[place < k], j[place < k], s[place < k], bound

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                b = whole.slice(start, 100)
                r = _numbers(b.column(1), b.num_rows) @ ix.rotation
                probe = _by_promise(r, ix.centroids)[:, : ix.probes]
                at = np.repeat(np.arange(len(r)), probe.shape[1])
                first = np.tile(np.arange(probe.shape[1]) < FIRST, len(r))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), _lists(r).take(take), pa.array(bounds(b)[3][at]), pa.array(probe.ravel().astype(np.int32)), pa.array(first)], names=["vec_id", "v", "r", "bound", "list", "first"])

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                b = whole.slice(start, 100)
                i, j, s, _ = bounds(b)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(shipped.value.anchor_ids[j]), pa.array(s)], names=["query_id", "vec_id", "score"])

    base = f"vec_id long, v array<{number}>, r array<float>"
    dealt = materialize(all_.mapInArrow(deal, f"{base}, list int"), "ann-lists")
    asked = materialize(asks.mapInArrow(ask, f"{base}, bound double, list int, first boolean"), "ann-asks")

    def packed(df: DataFrame, most: int, name: str) -> DataFrame:
        count = df.groupBy("list").agg(F.count(F.lit(1)).alias("m"))  # as many rows as lists, which the sample bounds: 8192 at 64 dimensions
        part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("m") / most)).alias("part")
        cols = [c for c in df.columns if c != "list"]
        return df.join(F.broadcast(count), "list").groupBy("list", part).agg(F.collect_list(F.struct(*cols)).alias(name)).drop("part")

    blocks = materialize(packed(dealt, BLOCK, "block"), "ann-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, some in zip(b.column(0), b.column(1)):
                block, some = block.values, some.values
                get = lambda rows, c: rows.field(c).to_numpy(zero_copy_only=False)
                vectors_ = lambda rows, c: _numbers(rows.field(c), len(rows))
                q, c, s = scan(vectors_(some, "v"), vectors_(some, "r"), get(some, "vec_id"), get(some, "bound"), vectors_(block, "v"), vectors_(block, "r"), get(block, "vec_id"), k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(s)], names=["query_id", "vec_id", "score"])

    def found(some: DataFrame) -> DataFrame:
        met = blocks.join(packed(some, QUERY_BLOCK, "asks"), "list").select("block", "asks")
        return met.repartition(F.col("block")[0]["vec_id"], F.col("asks")[0]["vec_id"]).mapInArrow(run, "query_id long, vec_id long, score double")

    def best(pairs: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    # the anchors that gave a bound count as found, so that no query comes back with fewer than k
    near = asks.mapInArrow(anchored, "query_id long, vec_id long, score double")
    early = materialize(best(found(asked.where("first").drop("first")).unionByName(near)), "ann-early")
    bound = early.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("better"))
    later = asked.where("NOT first").drop("first").join(bound, "vec_id", "left").withColumn("bound", F.coalesce("better", "bound")).drop("better")
    return best(found(later).unionByName(early.drop("rank")))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3: every 20th vector asks all others."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
