"""Exact and fuzzy deduplication, and removal by ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.graph import connected_components
from millrace.core.scratch import materialize
from millrace.core.session import prepare


def exact_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """Ids of all documents but the one with the smallest id of each group of equal texts; null texts have no group.

    A group's smallest id is an aggregate that combines before the shuffle; the
    join back is on two shuffled tables, whose hot keys AQE splits.
    """
    d = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("binary")).alias("h"))
    first = d.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first")
    return d.join(first, "h").where("id > first").select("id")


def minhash_signatures(df: DataFrame, text_col: str = "text", num_hashes: int = 260, char_ngrams: int = 24, seed: int = 42) -> DataFrame:
    """Add ``signature array<long>``: minima of random linear hashes of character n-grams.

    A text shorter than an n-gram is one shingle; null and empty texts have an
    empty signature.
    """
    prepare(df.sparkSession)
    sign, at = _signer(num_hashes, char_ngrams, seed), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sig = [sign(t) for t in x.column(at).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sig)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *sig])))
            yield pa.RecordBatch.from_arrays([*x.columns, lists], names=[*x.schema.names, "signature"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("signature", T.ArrayType(T.LongType()))]))


def _signer(num_hashes: int, char_ngrams: int, seed: int) -> Callable[[str | None], np.ndarray]:
    """Signature of a text: minima of random linear hashes, in 32-bit numbers, of its distinct shingles."""
    prime = (1 << 31) - 1
    rng = np.random.RandomState(seed)
    a, b = rng.randint(1, prime, num_hashes).astype(np.uint64), rng.randint(0, prime, num_hashes).astype(np.uint64)

    def signature(t: str | None) -> np.ndarray:
        if not t:
            return np.zeros(0, dtype=np.int64)
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = max(1, len(code) - char_ngrams + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(min(char_ngrams, len(code))):
            h = h * np.uint64(0x100000001B3) + code[k : k + n]
        h = np.unique((h ^ (h >> np.uint64(29))) % np.uint64(prime))
        out = np.full(num_hashes, prime, dtype=np.uint64)
        for i in range(0, len(h), 128):  # blocks that stay in the cache; modulo the prime by shifts: q = (x + (x >> 31) + 1) >> 31, then (x + q) & prime
            x = h[i : i + 128, None] * a
            x += b
            q = x >> np.uint64(31)
            q += x
            q += np.uint64(1)
            q >>= np.uint64(31)
            x += q
            x &= np.uint64(prime)
            np.minimum(out, x.min(axis=0), out=out)
        return out.astype(np.int64)

    return signature


def lsh_buckets(signatures: DataFrame, id_col: str = "id", bands: int = 20, rows: int = 13) -> DataFrame:
    """(band, bucket, id) for every band of every signature."""
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.md5(F.array_join(F.slice("signature", i * rows + 1, F.lit(rows)), ",").cast("binary")).alias("bucket")))
    return signatures.where(F.size("signature") >= bands * rows).select(F.col(id_col).alias("id"), F.explode(band).alias("b")).select("b.band", "b.bucket", "id")


def text_buckets(df: DataFrame, text_col: str = "text", id_col: str = "id", num_hashes: int = 260, char_ngrams: int = 24, bands: int = 20, rows: int = 13, seed: int = 42) -> DataFrame:
    """(band, bucket, id) straight from texts: signatures are made and cut into bands where the texts are; a bucket is a digest of 16 bytes."""
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sign = _signer(num_hashes, char_ngrams, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                s = sign(t)
                if len(s) >= bands * rows:
                    ids.append(i)
                    names += [hashlib.md5(s[k * rows : (k + 1) * rows].tobytes()).digest() for k in range(bands)]
            if ids:
                who = pa.array(np.repeat(np.array(ids), bands))
                yield pa.RecordBatch.from_arrays([b.column(0).take(who), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(ids))), pa.array(names, pa.binary())], names=["id", "band", "bucket"])

    return src.mapInArrow(run, T.StructType([src.schema["id"], T.StructField("band", T.IntegerType()), T.StructField("bucket", T.BinaryType())]))


def bucket_edges(buckets: DataFrame) -> DataFrame:
    """Edges (src, dst) that connect each bucket: every member with the smallest. No bucket is gathered."""
    first = buckets.groupBy("band", "bucket").agg(F.min("id").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "bucket", "src")
    first = materialize(first, "lsh-first")
    return buckets.join(first, ["band", "bucket"]).where("id <> src").select("src", F.col("id").alias("dst")).distinct()


def fuzzy_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "id", num_hashes: int = 260, char_ngrams: int = 24, bands: int = 20, rows: int = 13, seed: int = 42) -> DataFrame:
    """(id, group) of all documents that share a bucket, directly or through others; candidates aren't verified."""
    buckets = materialize(text_buckets(df, text_col, id_col, num_hashes, char_ngrams, bands, rows, seed), "lsh-buckets", "none")
    return connected_components(bucket_edges(buckets)).select(F.col("node").alias("id"), F.col("component").alias("group"))


def duplicate_ids(groups: DataFrame) -> DataFrame:
    """Of each group all ids but the smallest."""
    return groups.where(F.col("id") != F.col("group")).select("id")


def remove_ids(df: DataFrame, ids: DataFrame, id_col: str = "id", duplicate_id_col: str = "id") -> DataFrame:
    """Documents whose id isn't listed; the planner broadcasts a list that is small enough."""
    gone = ids.select(F.col(duplicate_id_col).alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti")
