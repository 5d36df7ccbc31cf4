"""Interleaved documents: one row for each text, image or metadata item of a sample.

Rows have sample_id, position (-1 for metadata), modality, content_type,
text_content, binary_content, source_ref and materialize_error; other columns pass.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import words

SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.StringType(), False), T.StructField("position", T.IntegerType(), False), T.StructField("modality", T.StringType(), False),
        T.StructField("content_type", T.StringType()), T.StructField("text_content", T.StringType()), T.StructField("binary_content", T.BinaryType()),
        T.StructField("source_ref", T.StringType()), T.StructField("materialize_error", T.StringType()),
    ]
)


def align(df: DataFrame, schema: T.StructType = SCHEMA) -> DataFrame:
    """The schema's columns first, cast or null where missing; the others behind them."""
    have, names = set(df.columns), set(schema.fieldNames())
    own = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*own, *(c for c in df.columns if c not in names))


def valid(df: DataFrame) -> DataFrame:
    """Known modalities only; metadata at -1, content at 0 or more."""
    place = F.when(F.col("modality") == "metadata", F.col("position") == -1).otherwise(F.col("position") >= 0)
    return df.where(F.col("modality").isin("text", "image", "metadata") & place)


def renumber(df: DataFrame) -> DataFrame:
    """Content positions count from 0 without gaps; metadata of samples without content goes.

    A position is the count of content rows before it, which a window over the
    sample gives; samples are small next to the table.
    """
    content = (F.col("modality") != "metadata").cast("int")
    w = W.partitionBy("sample_id")
    df = df.withColumn("__n", F.sum(content).over(w)).withColumn("__at", F.sum(content).over(w.orderBy("position", "modality").rowsBetween(W.unboundedPreceding, 0)) - 1)
    df = df.where("__n > 0")
    return df.withColumn("position", F.when(F.col("modality") == "metadata", F.lit(-1)).otherwise(F.col("__at")).cast("int")).drop("__n", "__at")


def keep_rows(df: DataFrame, keep: Column, modality: str = "image") -> DataFrame:
    """Drop rows of a modality for which ``keep`` isn't true, and what isn't valid; then renumber."""
    return renumber(valid(df).where((F.col("modality") != modality) | F.coalesce(keep, F.lit(False))))


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from the header of a PNG, GIF, BMP, WebP or JPEG; nulls for anything else."""
    def one(raw: bytes | None) -> tuple[int | None, int | None]:
        if not raw:
            return None, None
        try:
            if raw[:8] == b"\x89PNG\r\n\x1a\n":
                return struct.unpack(">II", raw[16:24])
            if raw[:6] in (b"GIF87a", b"GIF89a"):
                return struct.unpack("<HH", raw[6:10])
            if raw[:2] == b"BM":
                w, h = struct.unpack("<ii", raw[18:26])
                return w, abs(h)
            if raw[:4] == b"RIFF" and raw[8:16] == b"WEBPVP8X":
                return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
            if raw[:2] == b"\xff\xd8":
                i = 2
                while i + 9 < len(raw):
                    if raw[i] != 0xFF:
                        i += 1
                    elif 0xC0 <= raw[i + 1] <= 0xCF and raw[i + 1] not in (0xC4, 0xC8, 0xCC):
                        h, w = struct.unpack(">HH", raw[i + 5 : i + 9])
                        return w, h
                    else:
                        i += 2 + int.from_bytes(raw[i + 2 : i + 4], "big")
        except struct.error:
            pass
        return None, None

    return pd.DataFrame([one(x) for x in content], columns=["width", "height"])


def aspect_ratio_filter(df: DataFrame, least: float = 1.0, most: float = 2.0) -> DataFrame:
    """Keep images whose width over height is in the range; unreadable ones go."""
    size = image_size(F.col("binary_content"))
    ratio = F.when(size["height"] > 0, size["width"] / size["height"])
    return keep_rows(df, (ratio >= least) & (ratio <= most))


def image_text_ratio_filter(df: DataFrame, least: float = 0.0, most: float = float("inf")) -> DataFrame:
    """Keep samples whose images over words (1 at least) are in the range."""
    per = df.groupBy("sample_id").agg(
        F.sum((F.col("modality") == "image").cast("int")).alias("__images"),
        F.sum(F.when(F.col("modality") == "text", F.coalesce(F.size(words(F.col("text_content"))), F.lit(0))).otherwise(0)).alias("__words"),
    )
    ratio = F.col("__images") / F.greatest("__words", F.lit(1))
    return renumber(valid(df).join(per.where((ratio >= least) & (ratio <= most)).select("sample_id"), "sample_id", "left_semi"))


def blur_score(decode: Callable[[bytes], np.ndarray], content: Column) -> Column:
    """Variance of the Laplacian of a grey image; ``decode`` makes a 2-d array of bytes. Null where it can't."""
    @F.pandas_udf("double")
    def score(raws: pd.Series) -> pd.Series:
        def one(raw):
            try:
                g = np.asarray(decode(raw), dtype=np.float64)
            except Exception:  # what a decoder may raise is its own matter: unreadable is null
                return None
            lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
            return float(lap.var()) if lap.size else 0.0

        return raws.map(one)

    return score(content)


def score_filter(df: DataFrame, score: Column, least: float | None = None, below: float | None = None) -> DataFrame:
    """Keep images by an injected score: at least ``least``, under ``below``."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (score >= least)
    if below is not None:
        ok = ok & (score < below)
    return keep_rows(df, ok)


def image_text_similarity_filter(df: DataFrame, embedding_col: str, least: float) -> DataFrame:
    """Keep images whose largest inner product with a text of their sample reaches ``least``."""
    texts = df.where("modality = 'text'").select("sample_id", F.col(embedding_col).alias("__t"))
    dot = F.aggregate(F.zip_with(F.col(embedding_col), F.col("__t"), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    best = df.where("modality = 'image'").select("sample_id", "position", embedding_col).join(texts, "sample_id").groupBy("sample_id", "position").agg(F.max(dot).alias("__best"))
    marked = df.join(best, ["sample_id", "position"], "left")
    return keep_rows(marked, F.col("__best") >= least).drop("__best")


def drop_failed(df: DataFrame, how: str = "error") -> DataFrame:
    """Rows whose content couldn't be read: keep with ``warn``, drop with ``drop_row``, with their samples with ``drop_sample``; ``error`` raises."""
    failed = df.where(F.col("materialize_error").isNotNull())
    if how == "drop_row":
        return renumber(df.where(F.col("materialize_error").isNull()))
    if how == "drop_sample":
        return df.join(failed.select("sample_id").distinct(), "sample_id", "left_anti")
    if how == "error" and not failed.isEmpty():
        raise ValueError("some rows have no content")
    return df


def place_floaters(items: DataFrame) -> DataFrame:
    """Order a page's items: floating ones (pictures, captions) after the anchored one whose centre is nearest.

    ``items`` has page, item, floating, y (of the box's centre). Adds ``place``
    from 0. Anchored items keep their order; of equally near ones the first
    counts; floaters at one anchor go by height. Pages are small groups.
    """
    anchors = items.where("NOT floating").select("page", F.col("item").alias("__anchor"), F.col("y").alias("__y"))
    near = items.where("floating").join(anchors, "page").groupBy("page", "item").agg(F.min(F.struct(F.abs(F.col("y") - F.col("__y")).alias("d"), F.col("__anchor").alias("a"))).alias("m"))
    placed = items.join(near.select("page", "item", F.col("m.a").alias("__a")), ["page", "item"], "left")
    anchor = F.when(F.col("floating"), F.coalesce("__a", F.lit(-1))).otherwise(F.col("item"))
    order = W.partitionBy("page").orderBy(anchor, F.col("floating"), F.when(F.col("floating"), F.col("y")), "item")
    return placed.withColumn("place", F.row_number().over(order) - 1).drop("__a")
