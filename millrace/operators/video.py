"""Operators on videos and clips as rows: spans, scenes, windows, scores. Decoders and models are passed in."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _name_id(name: pd.Series) -> pd.Series:
    return name.map(lambda x: None if x is None else str(uuid.uuid5(uuid.NAMESPACE_URL, x)))


def fixed_stride(df: DataFrame, length: float, stride: float, least: float, file_col: str = "file", frames_col: str = "num_frames", rate_col: str = "framerate") -> DataFrame:
    """One row a span of ``length`` seconds every ``stride``, the last ones cut at the end; spans under ``least`` go.

    Adds ``clip_id`` (a name-based UUID of file and frames), ``span_start``,
    ``span_end``. Videos without a frame rate have no spans.
    """
    rate = F.col(rate_col).cast("double")
    df = df.withColumn("__d", F.when(rate > 0, F.col(frames_col) / rate)).where("__d > 0")
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.col("__d") / stride).cast("int")), lambda i: i * F.lit(float(stride)))
    df = df.withColumn("span_start", F.explode(starts)).withColumn("span_end", F.least(F.col("span_start") + length, F.col("__d")))
    df = df.where((F.col("span_start") < F.col("__d")) & (F.col("span_end") - F.col("span_start") >= least)).drop("__d")
    frame = lambda t: F.floor(F.col(t) * rate).cast("long").cast("string")
    return df.withColumn("clip_id", _name_id(F.concat_ws("_", F.col(file_col), frame("span_start"), frame("span_end"))))


def scenes(flags: Column, whole_if_none: bool = True) -> Column:
    """Spans [start, end) of frames between transitions, from an array of 0 and 1.

    A scene ends at a transition and the next begins after it; the last one
    ends with the last frame. Without a transition the video is one scene.
    """
    zero = F.expr("named_struct('prev', 0, 'start', 0, 'i', 0, 'out', cast(array() as array<struct<start:int,end:int>>))")

    def step(acc: Column, t: Column) -> Column:
        start = F.when((acc["prev"] == 1) & (t == 0), acc["i"]).otherwise(acc["start"])
        ends = (acc["prev"] == 0) & (t == 1) & (acc["i"] != 0)
        return F.struct(t.cast("int").alias("prev"), start.alias("start"), (acc["i"] + 1).alias("i"), F.when(ends, F.array_append(acc["out"], F.struct(start.alias("start"), acc["i"].alias("end")))).otherwise(acc["out"]).alias("out"))

    def last(acc: Column) -> Column:
        tail = F.array_append(acc["out"], F.struct(acc["start"].alias("start"), (acc["i"] - 1).alias("end")))
        whole = F.array(F.struct(F.lit(0).alias("start"), acc["i"].alias("end"))) if whole_if_none else acc["out"]
        return F.when(F.size(acc["out"]) == 0, whole).when(acc["prev"] == 0, tail).otherwise(acc["out"])

    return F.aggregate(flags, zero, step, last)


def fit_scenes(spans: Column, least: int | None = None, most: int | None = None, mode: str = "stride", crop: int | None = None) -> Column:
    """Scenes over ``most`` frames are cut off or into several; ends are cropped; those under ``least`` go."""
    cast = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    if most is not None and mode == "truncate":
        spans = F.transform(spans, lambda s: cast(s["start"], F.least(s["start"] + most, s["end"])))
    elif most is not None and mode == "stride":
        pieces = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((s["end"] - s["start"]) / most) - 1, F.lit(0)).cast("int")), lambda i: cast(s["start"] + i * most, F.least(s["start"] + (i + 1) * most, s["end"])))
        spans = F.flatten(F.transform(spans, pieces))
        if least is not None:
            spans = F.filter(spans, lambda s: s["end"] - s["start"] >= least)
    elif most is not None:
        raise ValueError(f"unknown mode {mode}")
    if crop is not None:
        spans = F.filter(F.transform(spans, lambda s: cast(s["start"] + crop, s["end"] - crop)), lambda s: s["end"] > s["start"])
    return spans if least is None else F.filter(spans, lambda s: s["end"] - s["start"] >= least)


def frame_windows(frames: Column, size: int = 128, remainder: int = 64, least: int = 4) -> Column:
    """Windows [start, end] of frames; a rest of ``remainder`` frames or more is one of its own, else the last one grows."""
    frames = frames.cast("int")
    full, rest = F.floor(frames / size).cast("int"), F.pmod(frames, F.lit(size))
    n = full + (rest >= remainder).cast("int")
    window = lambda i: F.struct((i * size).cast("int").alias("start"), F.when(i == n - 1, frames - 1).otherwise((i + 1) * size - 1).cast("int").alias("end"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    one = F.array(F.struct(F.lit(0).alias("start"), (frames - 1).alias("end")))
    return F.when(F.coalesce(frames, F.lit(0)) < least, none).when(frames <= size, one).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), window))


def motion_filter(df: DataFrame, mean_col: str = "motion_mean", patch_col: str = "motion_patch_min", least_mean: float = 0.00098, least_patch: float = 1e-6, score_only: bool = False) -> DataFrame:
    """Drop clips that hardly move, on the whole or in some patch; missing scores are -1."""
    for c in (mean_col, patch_col):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(-1.0)))
    return df if score_only else df.where((F.col(mean_col) >= least_mean) & (F.col(patch_col) >= least_patch))


def frame_score_filter(df: DataFrame, scores_col: str, least: float = 0.5, reduce: str = "min", out: str = "score") -> DataFrame:
    """Reduce scores of frames to their least or mean (-1 without frames) and keep clips that reach ``least``."""
    s = F.col(scores_col)
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(s)
    value = F.when(F.size(s) > 0, F.array_min(s).cast("double") if reduce == "min" else mean)
    return df.withColumn(out, F.coalesce(value, F.lit(-1.0))).where(F.col(out) >= least)


def sample_times(stamps: Column, fps: float) -> Column:
    """Indexes of the frames nearest to each of the times 0, 1/fps, 2/fps, ... up to the last stamp; ties go to the earlier frame."""
    last = F.element_at(stamps, -1)
    times = F.transform(F.sequence(F.lit(0), F.floor(last * fps).cast("int")), lambda i: i / F.lit(float(fps)))
    nearest = lambda t: F.array_min(F.transform(stamps, lambda s, i: F.struct(F.abs(s - t).alias("d"), i.alias("i"))))["i"]
    return F.when(F.size(stamps) > 0, F.transform(times, nearest))
