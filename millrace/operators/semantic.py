"""Semantic deduplication: k-means, ranking inside clusters, largest cosine to what ranks higher.

A cluster can hold any share of the rows, so it is never one task's group: it
is dealt into blocks, and pairs of blocks meet, each pair in a row of its own.
Their similarities come from one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.core.scratch import materialize
from millrace.core.session import prepare

from .dedup import remove_ids

#: Vectors in a block.
BLOCK = 1024


def normalized(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    v = v.cast("array<double>")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cluster(df: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", max_iter: int = 300, tol: float = 1e-4, seed: int = 42, fit_rows: int | None = None) -> DataFrame:
    """k-means of the normalised vectors: ``centroid``, ``l2_dist``, ``cosine_dist`` to it.

    With ``fit_rows`` the centroids are fitted on about so many rows, those
    that a hash of the id puts first; every row is assigned. Null vectors take
    no part. The centroids (k times the dimension) are broadcast.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.where(F.col(vec_col).isNotNull()).withColumn(vec_col, normalized(F.col(vec_col)))
    v = materialize(v, "semantic-vectors")
    n = v.count()
    if n == 0:
        return v.select("*", F.lit(0).alias("centroid"), F.lit(0.0).alias("l2_dist"), F.lit(0.0).alias("cosine_dist"))
    points = v.select(F.col(id_col), array_to_vector(F.col(vec_col)).alias("features"))
    if fit_rows and n > fit_rows:
        points = points.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(fit_rows / n * (1 << 20)) + 1)
    fitted = KMeans(k=min(k, n), initMode="k-means||", maxIter=max_iter, tol=tol, seed=seed).fit(points)
    centers = np.array(fitted.clusterCenters())
    shipped = df.sparkSession.sparkContext.broadcast(centers)
    at = v.columns.index(vec_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        unit = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
        for b in batches:
            x = b.column(at).flatten().to_numpy().reshape(b.num_rows, -1)
            d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
            near = d.argmin(axis=1)
            rows = np.arange(len(x))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(np.maximum(d[rows, near], 0))), pa.array(1 - (x * unit[near]).sum(1))],
                names=[*b.schema.names, "centroid", "l2_dist", "cosine_dist"],
            )

    schema = v.select("*", F.lit(0).alias("centroid"), F.lit(0.0).alias("l2_dist"), F.lit(0.0).alias("cosine_dist")).schema
    return v.mapInArrow(assign, schema)


def rank(df: DataFrame, id_col: str = "id", keep: str = "hard", by: list[tuple[str, bool]] | None = None, seed: int = 42) -> DataFrame:
    """Add ``rank`` from 0 in each cluster: what to keep comes first.

    ``hard`` puts far from the centroid first, ``easy`` near; ``random`` goes by
    a seeded hash; ``by`` names (column, ascending). The id breaks ties, in the
    same direction. Ranks come from a range sort of all rows and counts a
    partition, so that a large cluster isn't sorted in one task.
    """
    if by is None:
        down = keep == "hard"
        order = [F.desc("cosine_dist") if down else F.asc("cosine_dist"), F.desc(id_col) if down else F.asc(id_col)]
        if keep == "random":
            order = [F.asc(F.xxhash64(F.lit(seed), F.col(id_col))), F.asc(id_col)]
    else:
        order = [*(F.asc(c) if up else F.desc(c) for c, up in by), F.asc(id_col)]
    low = F.lit((1 << 33) - 1)
    part = materialize(df.sort("centroid", *order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(low)), "semantic-sorted")
    # where each cluster begins in each partition, and how many of it stand in those before
    own = part.groupBy("centroid", "__p").agg(F.min("__i").alias("__from"), F.count(F.lit(1)).alias("__n"))
    before = own.select("centroid", "__p", "__from", (F.sum("__n").over(W.partitionBy("centroid").orderBy("__p")) - F.col("__n")).alias("__before"))
    return part.join(before, ["centroid", "__p"]).withColumn("rank", F.col("__before") + F.col("__i") - F.col("__from")).drop("__p", "__i", "__from", "__before")


def pairwise(ranked: DataFrame, id_col: str = "id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, max_id, score): the largest cosine to any vector that ranks higher in the cluster, 0 at least.

    What ranks first gets 0 and, alone in its cluster, its own id. Of equal
    scores the one that ranks highest counts. What is removed still removes.
    """
    prepare(ranked.sparkSession)
    rows = ranked.select("centroid", "rank", F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.floor(F.col("rank") / block).cast("int").alias("b"))
    blocks = materialize(rows.groupBy("centroid", "b").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "v"))).alias("rows")), "semantic-blocks")
    last = blocks.groupBy("centroid").agg(F.max("b").alias("last"))
    left = blocks.join(last, "centroid").select("centroid", F.col("rows").alias("upper"), F.col("b").alias("ub"), F.explode(F.sequence(F.col("b"), F.col("last"))).alias("b"))
    met = left.join(blocks, ["centroid", "b"]).select((F.col("ub") == F.col("b")).alias("same"), "upper", F.col("rows").alias("lower"))
    kind = ranked.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, up, low = (batch.column(i)[k] for i in range(3))
                up, low = up.values, low.values
                a, b = (x.field("v").flatten().to_numpy().reshape(len(x), -1) for x in (up, low))
                s = b @ a.T
                if same.as_py():
                    s = np.where(np.arange(len(a))[None, :] < np.arange(len(b))[:, None], s, -np.inf)
                j = s.argmax(axis=1)
                best = s[np.arange(len(b)), j]
                yield pa.RecordBatch.from_arrays([low.field("id"), low.field("rank"), up.field("id").take(pa.array(j)), up.field("rank").take(pa.array(j)), pa.array(best)], names=["id", "rank", "max_id", "max_rank", "score"])

    best = met.mapInArrow(run, f"id {kind}, rank long, max_id {kind}, max_rank long, score double")
    top = best.groupBy("id").agg(F.max(F.struct(F.greatest("score", F.lit(0.0)).alias("score"), (-F.col("max_rank")).alias("r"), F.col("max_id").alias("max_id"))).alias("x"), F.min("rank").alias("rank"))
    first = F.col("rank") == 0
    return top.select("id", F.when(first, F.col("id")).otherwise(F.col("x.max_id")).alias("max_id"), F.when(first, 0.0).otherwise(F.col("x.score")).alias("score"))


def semantic_duplicates(df: DataFrame, k: int, eps: float = 0.01, id_col: str = "id", vec_col: str = "embedding", keep: str = "hard", by: list[tuple[str, bool]] | None = None, max_iter: int = 300, seed: int = 42) -> DataFrame:
    """(id, max_id, score) of vectors that are within ``eps`` of one that ranks higher."""
    ranked = rank(cluster(df, k, id_col, vec_col, max_iter, seed=seed), id_col, keep, by, seed)
    return pairwise(ranked, id_col, vec_col).where(F.col("score") >= 1 - eps)


def semantic_dedup(df: DataFrame, k: int, eps: float = 0.01, id_col: str = "id", vec_col: str = "embedding", **options) -> DataFrame:
    """Rows without those duplicates."""
    return remove_ids(df, materialize(semantic_duplicates(df, k, eps, id_col, vec_col, **options).select("id"), "semantic-ids"), id_col, "id")
