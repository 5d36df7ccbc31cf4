"""Exact repeats of a byte length anywhere in a corpus, by bucket-pointer refinement.

1. Each text's positions are put in buckets of growing depth (``_suffix``): the
   identifiers at one depth, at a position and at a later offset, name the
   bucket at twice the depth, up to the length asked for.
2. Each window of that length has an anchor, the least of the buckets of depth
   64 inside it. Windows repeat only where their anchors' bucket has several
   members, so buckets with one member are settled at once.
3. An anchor stands for the run of windows that share it. Where the whole run's
   text occurs again, the run is settled. What is left open is refined against
   one member of each distinct run of the bucket: window by window within one
   task while a bucket is small; a larger bucket is first split by halves of the
   runs, each named by all bytes that its windows have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.scratch import materialize
from millrace.core.session import prepare, read_table

from ._rows import texts
from ._suffix import GRAM, anchors, pair, refine

LENGTH = 400
#: Distinct runs of a bucket up to which one task refines it.
TASK_RUNS = 1000


def _key(text: Column) -> Column:
    """Identity of a text: equal texts have equal repeats."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _find_anchors(src: DataFrame, length: int) -> DataFrame:
    """(key, gram, run, a, p0, p1): the anchors of all windows, with the name of the text their windows span."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            keys, times = [], []
            for t in texts(b, "text"):
                raw = np.frombuffer(t.encode(), dtype=np.uint8)
                if len(raw) < length:
                    continue
                gram, _, full, _ = refine(raw, length)
                a, p0, p1 = anchors(gram, len(full), length - GRAM + 1)
                for x, y in zip(out, (gram[a], pair(full[p0], full[p1]) + (p1 - p0).astype(np.uint64), a, p0, p1)):
                    x.append(y)
                keys.append(hashlib.md5(raw).digest())
                times.append(len(a))
            if keys:
                g, r, *rest = (np.concatenate(x) for x in out)
                at = pa.array(np.repeat(np.arange(len(keys)), times))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(at), pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in rest)], names=["key", "gram", "run", "a", "p0", "p1"])

    return src.mapInArrow(run, "key binary, gram long, run long, a long, p0 long, p1 long")


_CONTEXT = "bucket long, m long, open boolean, key binary, p0 long, at long, ctx binary"


def _contexts(bodies: DataFrame, length: int) -> DataFrame:
    """(bucket, m, open, key, p0, at, ctx): for each run to refine the text that its windows span, and the anchor's place there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, t, runs in zip(b.column(0).to_pylist(), texts(b, "text"), b.column(2).to_pylist()):
                raw = t.encode()
                rows += [(r["gram"], r["m"], r["open"], key, r["p0"], r["a"] - r["p0"], raw[r["p0"] : r["p1"] + length]) for r in runs]
                if len(rows) > 2000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "m", "open", "key", "p0", "at", "ctx"])

    return bodies.mapInArrow(run, _CONTEXT)


def _windows(ctx: list[bytes], buckets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all windows of some contexts: (name, context, offset)."""
    raw = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    sizes = np.array([len(c) for c in ctx])
    starts = np.cumsum(sizes) - sizes
    full = refine(raw, length)[2]
    n = sizes - length + 1
    who = np.repeat(np.arange(len(ctx)), n)
    at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    return pair(full[starts[who] + at], buckets[who]), who, at


def _in_task(small: DataFrame, length: int) -> DataFrame:
    """(key, p0, p1): runs of repeated windows of open contexts; a bucket's rows follow each other."""
    def refined(rows: list[dict]) -> pa.RecordBatch:
        buckets = np.array([r["bucket"] for r in rows], dtype=np.int64).view(np.uint64)
        name, who, at = _windows([r["ctx"] for r in rows], buckets, length)
        _, back, count = np.unique(name, return_inverse=True, return_counts=True)
        open_ = np.array([r["open"] for r in rows])
        hit = (count[back] > 1) & open_[who]
        w, p = who[hit], at[hit]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1)])) if len(w) else np.zeros(0, dtype=np.int64)
        last = np.concatenate([first[1:], [len(w)]]) - 1 if len(w) else first
        base = np.array([r["p0"] for r in rows], dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array([rows[k]["key"] for k in w[first]], pa.binary()), pa.array(base[w[first]] + p[first]), pa.array(base[w[first]] + p[last])], names=["key", "p0", "p1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if len(held) >= TASK_RUNS and r["bucket"] != held[-1]["bucket"]:
                    yield refined(held)
                    held = []
                held.append(r)
        if held:
            yield refined(held)

    return small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key binary, p0 long, p1 long")


def _halves(large: DataFrame, length: int) -> DataFrame:
    """Each run as two, by how far its windows begin before the anchor (``lo`` to ``hi`` bytes).

    A half's bucket is named by what all windows of the range have in common,
    wherever they are, so equal windows stay in one bucket; ``run`` names the
    text that the half's own windows span.
    """
    name = lambda text, *n: int.from_bytes(hashlib.blake2b(text, digest_size=8, salt=b"".join(x.to_bytes(8, "little") for x in n)).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                ctx, at = r["ctx"], r["at"]
                mid = (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    first, last = max(0, at - hi), min(len(ctx) - length, at - lo)
                    if lo <= hi and first <= last:
                        part = ctx[first : last + length]
                        rows.append((name(ctx[at - lo : at + length - hi], lo, hi), name(part, at - first), r["open"], r["key"], r["p0"] + first, at - first, part, lo, hi))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["bucket", "run", "open", "key", "p0", "at", "ctx", "lo", "hi"])

    return large.mapInArrow(run, "bucket long, run long, open boolean, key binary, p0 long, at long, ctx binary, lo int, hi int")


def _refined(ctx: DataFrame, length: int) -> DataFrame:
    """(key, p0, p1): runs of repeated windows of the open contexts.

    Large buckets are split until they are small, or hold one run. Each round
    halves the ranges, so there are log2(length) rounds at most, and what a
    round settles doesn't enter the next.
    """
    found = [_in_task(ctx.where(F.col("m") <= TASK_RUNS), length)]
    large = ctx.where(F.col("m") > TASK_RUNS).select("open", "key", "p0", "at", "ctx", F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"))
    while not large.isEmpty():
        half = materialize(_halves(large, length), "suffix-halves")
        one = F.col("c") == 1
        runs = half.groupBy("bucket", "run").agg(F.count(F.lit(1)).alias("c"), F.max("open").alias("open"), F.min(F.struct("key", "p0")).alias("first"))
        runs = materialize(runs, "suffix-runs")
        more = runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.max(one & F.col("open")).alias("any")).where("any AND m > 1").select("bucket", "m")
        again = half.where("open").join(runs.where("c > 1").select("bucket", "run"), ["bucket", "run"], "left_semi")
        found.append(again.select("key", "p0", (F.col("p0") + F.octet_length("ctx") - length).alias("p1")))
        kept = half.drop("open").join(runs.select("bucket", "run", (F.col("open") & one).alias("open"), "first"), ["bucket", "run"]).where((F.col("key") == F.col("first.key")) & (F.col("p0") == F.col("first.p0")))
        kept = materialize(kept.drop("run", "first").join(more, "bucket"), "suffix-kept")
        found.append(_in_task(kept.where(F.col("m") <= TASK_RUNS), length))
        large = kept.where(F.col("m") > TASK_RUNS).select("open", "key", "p0", "at", "ctx", "lo", "hi")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, spans): for each distinct text with repeats, the bytes they cover.

    A byte is covered by a window of ``length`` bytes that starts also anywhere
    else: in any other row, or elsewhere in the same text. ``spans`` are maximal
    runs ``struct<start,end>`` of UTF-8 bytes, end exclusive. Null, empty and
    shorter texts have none; equal rows repeat each other; an empty table gives
    no rows; other columns don't matter. ``length`` must be 64 or more.

    Nothing is capped. What is shuffled for the search are anchors (one in
    about (length - 64) / 2 bytes), and texts with an open run, once each.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(text_col).alias("text")).where(F.octet_length(text_col) >= length)
    all_ = materialize(_find_anchors(src, length), "suffix-anchors")
    grams = materialize(all_.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram"), "suffix-grams")
    several = materialize(all_.join(grams, "gram", "left_semi"), "suffix-several")
    runs = several.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "a", "p0", "p1")).alias("at"))
    runs = materialize(runs.select("gram", "c", "at.*"), "suffix-runs")
    open_ = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least")).where("least = 1").select("gram", "m")
    todo = runs.join(materialize(open_, "suffix-open"), "gram").select("key", F.struct("gram", "m", (F.col("c") == 1).alias("open"), "a", "p0", "p1").alias("r"))
    todo = materialize(todo.groupBy("key").agg(F.collect_list("r").alias("runs")), "suffix-todo")
    bodies = src.withColumn("key", _key(F.col("text"))).select("key", "text")
    bodies = bodies.join(todo.select("key"), "key", "left_semi").dropDuplicates(["key"]).join(todo, "key").select("key", "text", "runs")
    ctx = materialize(_contexts(bodies, length), "suffix-contexts")
    fine = _refined(ctx, length)

    # settled runs are those of repeated buckets that aren't open; per text, once however often it occurs
    none = F.lit(None).cast("long")
    parts = several.select("key", "a", "p0", "p1", F.lit(0).alias("kind")).distinct()
    parts = parts.unionByName(runs.where("c = 1").select("key", "a", none.alias("p0"), none.alias("p1"), F.lit(1).alias("kind")))
    parts = parts.unionByName(fine.select("key", none.alias("a"), "p0", "p1", F.lit(2).alias("kind")))
    lists = parts.groupBy("key").agg(F.collect_list(F.struct("kind", "a", "p0", "p1")).alias("x"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, spans = [], []
            for key, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = x.values
                kind, a, p0, p1 = (v.field(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in range(4))
                live = (kind == 2) | (kind == 0) & ~np.isin(a, a[kind == 1])
                order = np.argsort(p0[live], kind="stable")
                s, e = p0[live][order], np.maximum.accumulate(p1[live][order] + length) if live.any() else p1[live]
                cut = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]])) if len(s) else []
                if len(s):
                    keys.append(key)
                    spans.append([{"start": int(s[i]), "end": int(e[j])} for i, j in zip(cut, [*(cut[1:] - 1), len(s) - 1])])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["key", "spans"])

    return lists.mapInArrow(merge, "key binary, spans array<struct<start:long,end:long>>")


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Add ``spans`` (bytes that repeats cover) and ``kept binary`` (the other bytes) to every row.

    Cutting bytes may split a character, so what is kept is binary. Rules for
    nulls, short texts, repeated rows and empty tables as in ``repeated_spans``;
    columns named ``spans`` or ``kept`` are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in {"spans", "kept"}]
    spans = materialize(repeated_spans(docs, text_col, length), "suffix-spans")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(text_col).alias("text")).withColumn("key", _key(F.col("text")))
    out = row.join(spans, "key", "left").select("row", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"))
    # the gaps between spans, in order; offsets are of bytes
    step = lambda acc, s: F.struct(F.concat(acc["kept"], F.substring(F.col("raw"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("kept"), s["end"].alias("at"))
    zero = F.struct(F.lit(b"").cast("binary").alias("kept"), F.lit(0).cast("long").alias("at"))
    kept = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["kept"], F.substring(F.col("raw"), (acc["at"] + 1).cast("int"), F.octet_length("raw"))))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "spans", kept.alias("kept"))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5: repeats of 400 bytes over all documents."""
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", n.alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB SQL of the query: all windows of all texts by their digest, runs of repeated ones, what lies between them.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT rid, unnest(range(1, n - {LENGTH - 2})) AS i, unnest(list_transform(range(1, n - {LENGTH - 2}), lambda i: md5(b[i:i + {LENGTH - 1}]))) AS h FROM d WHERE n >= {LENGTH}),
r AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
p AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM s WHERE h IN (SELECT h FROM r)),
q AS (SELECT rid, i, sum(CASE WHEN gap <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM p),
spans AS (SELECT rid, k, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM q GROUP BY rid, k),
lists AS (SELECT rid, [0] || list(z ORDER BY a) AS zs, list(a ORDER BY a) AS al, sum(z - a + 1)::BIGINT AS gone FROM spans GROUP BY rid),
cuts AS (SELECT d.*, gone, al, zs, al || [n + 1] AS ends FROM d LEFT JOIN lists USING (rid))
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(len(al), 0) AS n_spans,
  sha256(CASE WHEN al IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(1, len(ends) + 1), lambda j: CASE WHEN ends[j] - 1 > zs[j] THEN hex(b[zs[j] + 1:ends[j] - 1]) ELSE '' END), '')) END) AS kept_sha256
FROM cuts"""
