"""Operators that change which rows there are: ids, splitting, joining, merging chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def add_id(df: DataFrame, id_col: str, prefix: str | None = None, order_by: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """Unique ids. With ``order_by`` they are positions in that order, the same on every run; without, no shuffle.

    The positions come from a range sort and per-partition counts, not from a
    window over all rows in one task.
    """
    if id_col in df.columns and not overwrite:
        raise ValueError(f"column {id_col} is there already")
    if order_by:
        part = df.sort(*order_by).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        low = F.lit((1 << 33) - 1)
        counts = part.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
        before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
        df = part.join(F.broadcast(before), "__part").withColumn(id_col, F.col("__before") + F.col("__at").bitwiseAND(low)).drop("__part", "__at", "__before")
    else:
        df = df.withColumn(id_col, F.monotonically_increasing_id())
    return df.withColumn(id_col, F.concat_ws("_", F.lit(prefix), F.lpad(F.col(id_col).cast("string"), 10, "0"))) if prefix else df


def split_documents(df: DataFrame, separator: str, text_col: str = "text", segment_col: str = "segment_id") -> DataFrame:
    """One row for each piece between literal separators, numbered from 0; empty pieces stay."""
    rest = [c for c in df.columns if c not in {text_col, segment_col}]
    quoted = "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return df.select(*rest, F.posexplode(F.split(text_col, quoted, -1)).alias(segment_col, text_col))


def join_documents(df: DataFrame, separator: str = "\n\n", id_col: str = "id", text_col: str = "text", segment_col: str = "segment_id", max_length: int | None = None, length_col: str | None = None) -> DataFrame:
    """Join a document's segments in their order; with ``max_length`` fill rows greedily up to it.

    Other columns keep their first non-null value. Rows with a null id go. With
    ``max_length`` the segments are renumbered; a segment that is longer than
    the limit has a row of its own.
    """
    df = df.where(F.col(id_col).isNotNull())
    rest = [c for c in df.columns if c not in {id_col, text_col, segment_col, length_col}]
    n = F.col(length_col).cast("long") if length_col else F.length(text_col).cast("long")
    seg = F.array_sort(F.collect_list(F.struct(F.col(segment_col).alias("s"), F.col(text_col).alias("t"), n.alias("n"))))
    grouped = df.groupBy(id_col).agg(seg.alias("__seg"), *(F.first(c, ignorenulls=True).alias(c) for c in rest))
    if max_length is None:
        return grouped.select(id_col, F.array_join(F.transform("__seg", lambda x: x["t"]), separator).alias(text_col), *rest)
    zero = F.expr("named_struct('done', cast(array() as array<struct<t:string,n:bigint>>), 't', cast(null as string), 'n', 0L)")

    def step(acc, x):
        grown = acc["n"] + x["n"] + len(separator)
        fits = acc["t"].isNotNull() & (grown <= max_length)
        flush = F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["n"].alias("n")))
        return F.struct(
            F.when(fits | acc["t"].isNull(), acc["done"]).otherwise(flush).alias("done"),
            F.when(fits, F.concat(acc["t"], F.lit(separator), x["t"])).otherwise(x["t"]).alias("t"),
            F.when(fits, grown).otherwise(x["n"]).alias("n"),
        )

    done = F.aggregate("__seg", zero, step, lambda acc: F.when(acc["t"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["t"].alias("t"), acc["n"].alias("n")))))
    out = grouped.select(id_col, F.posexplode(done).alias(segment_col, "__x"), *rest)
    return out.select(id_col, segment_col, F.col("__x.t").alias(text_col), *([F.col("__x.n").alias(length_col)] if length_col else []), *rest)


def merge_chunks(df: DataFrame, group_cols: list[str], chunk_col: str = "chunk_id", text_col: str = "cleaned_text", sum_cols: list[str] = (), max_length: int | None = None, separator: str = "\n", no_content: tuple[str, ...] = ("", "\n")) -> DataFrame:
    """Put a text together from its chunks in order.

    A chunk that repeats counts once; chunks without content don't count; sums
    of nothing but nulls are 0; other columns keep their first non-null value;
    texts over ``max_length`` go.
    """
    df = df.dropDuplicates([*group_cols, chunk_col]).where(F.col(text_col).isNotNull() & ~F.col(text_col).isin(*no_content))
    rest = [c for c in df.columns if c not in {*group_cols, chunk_col, text_col, *sum_cols}]
    ordered = F.array_sort(F.collect_list(F.struct(F.col(chunk_col).alias("c"), F.col(text_col).alias("t"))))
    out = df.groupBy(*group_cols).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias(text_col),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sum_cols), *(F.first(c, ignorenulls=True).alias(c) for c in rest),
    )
    return out.where(F.length(text_col) <= max_length) if max_length is not None else out
