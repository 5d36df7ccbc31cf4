"""Connected components by joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop_table, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list.

    Alternating large-star and small-star rounds. No neighbour list is ever
    gathered: a star's centre is found by ``min`` (combined before the
    shuffle) and sent back by a join of two shuffled tables, whose large
    partitions AQE can split, so a node with a third of all edges is no hot
    task. Written rounds compress so well that the planner takes large ones for
    small, so it is told not to broadcast them. Every round is written to the shared folder.

    Parameters: ``edges`` with two columns of one orderable type. Nulls and
    loops are ignored; repeated edges count once; an empty input gives an
    empty result. Returns ``node, component`` for every node on an edge.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    if _stars(e):  # as from buckets that share no member: settled without a round
        return _named(e)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points at the smallest of u's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "cc-large")
        # small star: u and its smaller neighbours point at the smallest of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        changed = not (new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty())
        for old in (e, least, large, low):
            drop_table(old)
        e = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return _named(e)


def _stars(e: DataFrame) -> bool:
    """Whether every edge (u > v) joins a node of one edge with a centre that is no such node."""
    twice = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.isEmpty() and e.join(e.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").isEmpty()


def _named(e: DataFrame) -> DataFrame:
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
