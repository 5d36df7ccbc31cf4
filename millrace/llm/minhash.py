"""Near-duplicate documents: bottom-k sketches from one hash function.

1. A document's set of distinct word shingles becomes 64-bit hashes; its k
   smallest hashes are its sketch. Documents with equal sets form one class.
2. Inverted lists of retained values. A pair that is similar enough shares at
   least ``cut`` retained values, so with each class's values ordered rare
   first it shares one among the first k - cut + 1: only those are listed.
3. Short lists give all their pairs. A long list gives each member's pair with
   one hub, the member whose values are listed most; members that end up in the
   hub's component need no more, and the others are compared in blocks with all
   members of the lists that have this hub: by their sketches first, and those
   with a possible partner on their full sets.
4. The union sketch of a pair estimates its similarity and drops pairs below
   ``cut`` of k; the rest are verified on their full sets.
5. Connected components of verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.graph import connected_components
from millrace.core.scratch import materialize
from millrace.core.session import prepare, read_table

from ._rows import texts
from ._words import BASE, Q, blocks, hash_words, mix

#: Values that a sketch retains.
K = 40
#: Chance that a pair of exactly the threshold's similarity is not a candidate.
MISS = 1e-9
#: Members up to which a list gives all its pairs.
LIST = 16
#: Members, and shingles of them, in a block of a hub's members.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Pairs of one node that meet its sketch or text in one place; the pairs of a node with more are salted.
NODE_PAIRS = 1000
#: Rows (an id and two keys, under 64 bytes each) up to which the classes whose text is asked for are broadcast.
BROADCAST_ROWS = 1 << 19
WIDTH, NUM, DEN = 5, 80, 100

def shingle_sets(texts_: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are what separators (space, 0x09 to 0x0D) leave, with A-Z in lower
    case. A text with fewer than ``width`` words has its whole sequence as one
    shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    for block in blocks(texts_):
        got = hash_words(block)
        words, n = got.hashes, max(0, len(got.hashes) - width + 1)
        run = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            run = run * np.uint64(Q) + words[k : k + n]
        run = mix(run)
        a = 0
        for b in got.ends.tolist():
            if b - a >= width:
                out.append(np.unique(run[a : b - width + 1]))
            elif b > a:
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        h = h * np.uint64(BASE) + w
                out.append(mix(np.array([h], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            a = b
    return out


@lru_cache(maxsize=16)
def cut_for(t: float, k: int = K, miss: float = MISS) -> int:
    """The most c with P(Binomial(k, t) < c) <= miss: shared values that a similar pair surely has."""
    tail, c = 0.0, 0
    while (tail := tail + comb(k, c) * t**c * (1 - t) ** (k - c)) <= miss:
        c += 1
    return max(1, c)


def prefix_for(n: int, t: float, k: int = K) -> int:
    """How many of the rarest values must be listed for a set of n shingles."""
    if n >= k:
        return k - cut_for(t, k) + 1
    return n - max(1, min(ceil(t * n), floor(k - (1 - t) / t * n))) + 1


def union_count(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[int, int]:
    """Of the k smallest values of the union of two sketches: how many, and how many are in both."""
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~same])][:k]
    return len(union), int(np.count_nonzero(both[1:][same] <= union[-1])) if len(union) else 0


def _may_link(a: np.ndarray, b: np.ndarray, t: float) -> bool:
    n, c = union_count(a, b)
    return c >= (cut_for(t) if n == K else t * n - 1e-9)


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: id, set size, key of the set, sketch, and a key of the text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = texts(b, "text")
            sets = shingle_sets(t, width)
            key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            text_key = [hashlib.md5(x.encode()).digest() for x in t]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array([s[:K].tobytes() for s in sets], pa.binary()), pa.array(text_key, pa.binary())],
                names=["id", "n", "key", "sketch", "text_key"],
            )

    return src.mapInArrow(run, T.StructType([src.schema["id"], *(T.StructField(c, k) for c, k in (("n", T.LongType()), ("key", T.BinaryType()), ("sketch", T.BinaryType()), ("text_key", T.BinaryType())))]))


def _values(classes: DataFrame) -> DataFrame:
    """(value, node, n, size of the sketch) of all retained values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.frombuffer(x, dtype=np.int64) for x in b.column(2).to_pylist()]
            sizes = np.array([len(x) for x in s], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(s) if s else np.zeros(0, dtype=np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(np.repeat(b.column(1).to_numpy(), sizes))], names=["v", "node", "n"]
            )

    return classes.select("node", "n", "sketch").mapInArrow(run, "v long, node long, n long")


def _joined(pairs: DataFrame, side: DataFrame, x: str, what: str) -> DataFrame:
    """Pairs with what ``side`` (node, ``what``) holds of node ``x``; a node of many pairs is copied to several places, in proportion."""
    many = pairs.groupBy(x).agg(F.ceil(F.count(F.lit(1)) / NODE_PAIRS).alias("salts")).where("salts > 1")
    many = materialize(many, "near-many")
    side = side.select(F.col("node").alias(x), F.col(what).alias(f"{what}_{x}"))
    if many.isEmpty():
        return pairs.join(side, x)
    salted = pairs.join(many, x, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("salts", F.lit(1)))).drop("salts")
    copied = side.join(many, x, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(copied, [x, "salt"]).drop("salt")


def _filter_pairs(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) whose union sketch allows a link."""
    both = _joined(_joined(pairs, classes, "a", "sketch"), classes, "b", "sketch").select("a", "b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sa, sb = ([np.frombuffer(x, dtype=np.uint64) for x in b.column(i).to_pylist()] for i in (2, 3))
            keep = pa.array([_may_link(x, y, t) for x, y in zip(sa, sb)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    return both.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, bodies: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs whose full sets have den * intersection >= num * union."""
    both = _joined(_joined(pairs, bodies, "a", "text"), bodies, "b", "text").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sa, sb = (shingle_sets(texts(b, c), width) for c in ("text_a", "text_b"))
            keep = []
            for x, y in zip(sa, sb):
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of two lists of sets, by matrix products over their common values."""
    all_l, all_r = np.concatenate(left), np.concatenate(right)
    common, shared = np.intersect1d(all_l, all_r), np.zeros((len(left), len(right)), dtype=np.float32)
    for k in range(0, len(common), 4096):
        part = common[k : k + 4096]
        hot = []
        for sets, flat in ((left, all_l), (right, all_r)):
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            one = np.zeros((len(sets), len(part)), dtype=np.float32)
            one[np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]] = 1
            hot.append(one)
        shared += hot[0] @ hot[1].T
    return shared


def _block_links(members: DataFrame, bodies: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links between a hub's unsettled members and all its members, block by block.

    ``members`` has (hub, node, n, comp, rest, sketch); ``rest`` marks the
    unsettled. Blocks hold sets of like size, and only blocks whose sizes allow
    a link meet, each pair of blocks in its own row. They meet as sketches;
    members without a possible partner in the other block go no further, so
    members that are like none cost no text. What is left meets with its texts,
    intersections of all pairs of two blocks come from one matrix product over
    their shared shingles, and every pair is verified on its full sets. Out come
    only the links that join components which earlier links of the same row
    haven't joined.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))).alias("size")
    m = members.select("hub", "node", "n", "comp", "rest", "sketch", size)
    total = lambda df, c: df.groupBy("hub", "size").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias(c))
    part_of = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).alias("part")
    pack = lambda df, c, x: (
        df.join(total(df, c), ["hub", "size"]).select("hub", "size", part_of(c), "node", "comp", "sketch")
        .repartition("hub", "size", "part").groupBy("hub", "size", "part").agg(F.collect_list(F.struct("node", "comp", "sketch")).alias(x))
    )
    right = materialize(pack(m, "parts", "right"), "near-right")
    parts = right.groupBy(F.col("hub"), F.col("size").alias("meets")).agg(F.max("part").alias("last"))
    left = pack(m.where("rest"), "p", "left").drop("part").withColumn("meets", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).drop("size")
    left = left.join(parts, ["hub", "meets"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last").cast("int")))).drop("last")
    met = left.withColumn("part", F.col("part").cast("long")).join(right.withColumnRenamed("size", "meets").withColumn("part", F.col("part").cast("long")), ["hub", "meets", "part"]).select("left", "right", "hub")
    t = num / den

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                sl, sr = ([np.frombuffer(x["sketch"], dtype=np.uint64) for x in side] for side in sides)
                shared = _shared(sl, sr)
                union = np.array([len(x) for x in sl])[:, None] + np.array([len(x) for x in sr])[None, :] - shared
                cl, cr = (np.array([x["comp"] for x in side]) for side in sides)
                may = np.where(union >= K, shared >= cut_for(t), shared >= t * union - 1e-9) & (cl[:, None] != cr[None, :])
                rows = [(batch.column(2)[i].as_py(), sides[0][0]["node"], sides[1][0]["node"], k == 1, x["node"], x["comp"]) for k, side in enumerate(sides) for x, some in zip(side, may.any(axis=1 - k)) if some]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=["hub", "k1", "k2", "right", "node", "comp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                both = batch.column(0)[i].as_py()
                left, right = ([x for x in both if x["right"] == side] for side in (False, True))
                if not left or not right:
                    continue
                sl, sr = (shingle_sets([x["text"] or "" for x in side], width) for side in (left, right))
                shared = _shared(sl, sr)
                union = np.array([len(x) for x in sl])[:, None] + np.array([len(x) for x in sr])[None, :] - shared
                cl, cr = (np.array([x["comp"] for x in side]) for side in (left, right))
                above: dict[int, int] = {}

                def top(x: int) -> int:
                    while (y := above.get(x, x)) != x:
                        x = y
                    return x

                a, b = [], []
                for p, q in np.argwhere((den * shared >= num * union) & (cl[:, None] != cr[None, :])).tolist():
                    x, y = top(int(cl[p])), top(int(cr[q]))
                    if x != y:
                        above[max(x, y)] = min(x, y)
                        a.append(left[p]["node"])
                        b.append(right[q]["node"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    asked = materialize(met.mapInArrow(sketched, "hub long, k1 long, k2 long, right boolean, node long, comp long").distinct(), "near-asked")
    blocks_ = asked.join(bodies, "node").groupBy("hub", "k1", "k2").agg(F.collect_list(F.struct("right", "node", "comp", "text")).alias("x"))  # two blocks at most
    return blocks_.select("x").mapInArrow(run, "a long, b long")


def _key_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """Near-duplicate groups: documents linked by ``den * |A & B| >= num * |A | B|``.

    Returns one row for each input row: ``id`` (named as ``id_col``),
    ``n_shingles long``, ``component_id`` (smallest id reachable, itself
    included) and ``kept boolean`` (its id is the component's). Documents
    without words are linked with nothing. Null texts are empty; null ids are
    never a component's id unless nothing else is there, and rows with one are
    kept only if they are alone without any id; repeated rows have equal sets
    and so one component; an empty table gives no rows; other columns don't
    matter. No candidate is capped: long lists go by hubs and blocks.
    """
    spark, t = prepare(docs.sparkSession), num / den
    rows = materialize(_signatures(docs, id_col, text_col, width), "near-rows")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min(F.struct("id", "text_key")).alias("body"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    # inverted lists of the rarest values
    values = _values(classes)
    shared = materialize(values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-shared")
    prefix = F.when(F.col("n") >= K, F.lit(prefix_for(K, t)))
    for n in range(1, K):
        prefix = prefix.when(F.col("n") == n, F.lit(prefix_for(n, t)))
    mine = values.join(shared, "v").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("vs"))
    alone = F.least(F.col("n"), F.lit(K)) - F.size("vs")  # values that nobody else has come first
    central = F.aggregate("vs", F.lit(0).cast("long"), lambda acc, x: acc + x["c"]).alias("central")
    mine = mine.select("node", "n", central, F.explode(F.slice("vs", 1, F.greatest(F.lit(0), prefix - alone).cast("int"))["v"]).alias("v"))
    lists = materialize(mine, "near-lists")
    sizes = lists.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("central", "node", "n")).alias("hub"))
    sizes = materialize(sizes.where("m > 1").select("v", "m", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "near-sizes")

    fits = lambda x, y: (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)
    short = lists.join(sizes.where(F.col("m") <= LIST).select("v"), "v")
    left = short.select("v", F.col("node").alias("a"), F.col("n").alias("na"))
    right = short.select("v", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "v").where((F.col("a") < F.col("b")) & fits("na", "nb")).select("a", "b")
    long = lists.join(sizes.where(F.col("m") > LIST), "v")
    hubs = long.where((F.col("node") != F.col("hub")) & fits("n", "hub_n")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = materialize(_filter_pairs(pairs.unionByName(hubs).distinct(), classes, t), "near-pairs")

    # texts are dealt once, for the pairs and for what long lists may still need
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long.select("node"))
    bodies = _bodies(docs, id_col, text_col, classes, asked)
    links = materialize(_verify(pairs, bodies, width, num, den), "near-links")
    comps = materialize(connected_components(links, "a", "b"), "near-comps")

    # members of long lists that aren't in their hub's component
    named = classes.select("node").join(comps, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    placed = materialize(long.select("hub", "node", "n").distinct().join(named, "node"), "near-placed")
    hub_of = placed.where("node = hub").select("hub", F.col("comp").alias("hub_comp"))
    placed = materialize(placed.join(hub_of, "hub").withColumn("rest", F.col("comp") != F.col("hub_comp")).drop("hub_comp"), "near-placed")
    unsettled = materialize(placed.where("rest").select("hub").distinct(), "near-unsettled")
    if not unsettled.isEmpty():
        members = materialize(placed.join(unsettled, "hub").join(classes.select("node", "sketch"), "node"), "near-members")
        more = materialize(_block_links(members, bodies, width, num, den), "near-links")
        comps = materialize(connected_components(links.unionByName(more), "a", "b"), "near-comps")

    named = classes.join(comps, "node", "left").select("key", "least", F.coalesce("component", "node").alias("comp"))
    first = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(first, "comp").select("key", "component_id"), "near-named")
    out = rows.join(named, "key", "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def _bodies(docs: DataFrame, id_col: str, text_col: str, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One text for each class that is asked for: of its first row, so that copies don't meet in one place."""
    need = nodes.distinct().join(classes.select("node", F.col("body.id").alias("of"), F.col("body.text_key").alias("text_key")), "node")
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    text, need = text.withColumn("text_key", _key_of(F.col("text"))), materialize(need, "near-need")
    side = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need  # beyond, texts are dealt by key
    found = text.join(side, (text["text_key"] == need["text_key"]) & text["id"].eqNullSafe(need["of"]))
    return materialize(found.dropDuplicates(["node"]).select("node", "text"), "near-bodies")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over all documents: links from a similarity of 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), num=85, den=100)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB SQL of the query: all pairs by their shared shingles, components by a recursive closure.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c ON x = doc_id LEFT JOIN n USING (doc_id)"""
