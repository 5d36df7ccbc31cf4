"""Interval logic on nested segments: gaps, overlaps, packing, merging, mapping of times.

A row has an array of structs with ``start`` and ``end`` in seconds. What an
ordered fold or a lambda can say stays in the JVM; the rest runs on Arrow
batches. Rows are independent, so nothing here shuffles. A null array gives
null; an empty one gives what an empty list means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_SPEAKER = "no-speaker"
SPAN = "array<struct<start:double,end:double>>"


def by_row(df: DataFrame, fn: Callable[[dict], dict], added: str) -> DataFrame:
    """Add columns that a Python function makes of each row; for state machines that no expression says."""
    new = T._parse_datatype_string(added)
    names = {f.name for f in new}
    keep = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*keep, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = b.to_pylist()
            out = [{**{f.name: r[f.name] for f in keep}, **fn(r)} for r in rows]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _sorted(segments: Column) -> Column:
    less = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] < b["end"], -1).when(a["end"] > b["end"], 1).otherwise(0)
    return F.array_sort(segments, less)


def gaps(segments: Column, duration: Column, max_length: float | None = None) -> Column:
    """Spans between a segment's end and the next one's start, and up to ``duration``; long ones in pieces."""
    s = F.transform(_sorted(segments), lambda x: F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end")))
    before = F.concat(F.array(F.lit(0.0)), F.transform(s, lambda x: x["end"]))
    after = F.concat(F.transform(s, lambda x: x["start"]), F.array(duration.cast("double")))
    found = F.filter(F.arrays_zip(before.alias("start"), after.alias("end")), lambda x: x["end"] > x["start"])
    if max_length is None:
        return found
    pieces = lambda g: F.transform(
        F.sequence(F.lit(0), (F.ceil((g["end"] - g["start"]) / max_length) - 1).cast("int")),
        lambda i: F.struct((g["start"] + i * max_length).alias("start"), F.least(g["start"] + (i + 1) * max_length, g["end"]).alias("end")),
    )
    return F.flatten(F.transform(found, pieces))


def add_gaps(segments: Column, duration: Column, max_length: float | None = None) -> Column:
    """Segments (start, end, speaker) with the gaps as segments of nobody, by start."""
    own = F.transform(segments, lambda x: F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end"), x["speaker"].alias("speaker")))
    rest = F.transform(gaps(segments, duration, max_length), lambda g: F.struct(g["start"], g["end"], F.lit(NO_SPEAKER).alias("speaker")))
    return _sorted(F.concat(own, rest))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _overlapping(start: pd.Series, end: pd.Series, least: pd.Series) -> pd.Series:
    def one(a, b, low) -> list[int] | None:
        if a is None or b is None:
            return None
        s, e = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
        order = np.lexsort((e, s))
        s, e = s[order], e[order]
        bad = np.zeros(len(s), dtype=bool)
        stop = np.searchsorted(s, e, side="left")  # later ones that start before this one ends
        for i in range(len(s)):
            j = np.arange(i + 1, max(i + 1, stop[i]))
            inside = np.minimum(e[i], e[j]) - s[j]
            hit = (inside >= low) | (e[j] <= e[i]) | ((s[j] == s[i]) & (e[j] >= e[i]))
            hit &= inside > 0
            bad[j[hit]] = True
            bad[i] |= hit.any()
        return np.sort(order[bad]).tolist()

    return pd.Series([one(*x) for x in zip(start, end, least)])


def overlapping(segments: Column, least: float = 0.5) -> Column:
    """Indexes of segments that share ``least`` seconds with another one, contain one or lie in one."""
    return _overlapping(F.transform(segments, lambda x: x["start"].cast("double")), F.transform(segments, lambda x: x["end"].cast("double")), F.lit(least))


def drop_overlapping(df: DataFrame, segments_col: str = "segments", least: float = 0.5) -> DataFrame:
    """Drop segments without text, then all that overlap another; ``dropped_empty`` and ``dropped_overlap`` count them."""
    full = F.filter(segments_col, lambda x: F.length(F.trim(F.coalesce(x["text"], F.lit("")))) > 0)
    df = df.withColumn("dropped_empty", F.size(segments_col) - F.size(full)).withColumn(segments_col, _sorted(full)).withColumn("__bad", overlapping(F.col(segments_col), least))
    df = df.withColumn("dropped_overlap", F.size("__bad"))
    return df.withColumn(segments_col, F.filter(segments_col, lambda x, i: ~F.array_contains("__bad", i))).drop("__bad")


def pack(segments: Column, max_span: float, max_gap: float) -> Column:
    """Greedy runs of segments: ``struct<start,end,first,last>`` by index, closed where span or gap would be too long."""
    empty = F.expr("named_struct('done', cast(array() as array<struct<start:double,end:double,first:int,last:int>>), 'start', cast(null as double), 'end', cast(null as double), 'first', 0, 'at', 0)")

    def step(acc: Column, x: Column) -> Column:
        s, e = x["start"].cast("double"), x["end"].cast("double")
        fits = (e - acc["start"] <= max_span) & (s - acc["end"] <= max_gap)
        opened = acc["start"].isNull() | ~fits
        closed = F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["end"].alias("end"), acc["first"].alias("first"), (acc["at"] - 1).alias("last")))
        return F.struct(
            F.when(acc["start"].isNull() | fits, acc["done"]).otherwise(closed).alias("done"), F.when(opened, s).otherwise(acc["start"]).alias("start"), e.alias("end"),
            F.when(opened, acc["at"]).otherwise(acc["first"]).alias("first"), (acc["at"] + 1).alias("at"),
        )

    last = lambda acc: F.when(acc["start"].isNull(), acc["done"]).otherwise(
        F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["end"].alias("end"), acc["first"].alias("first"), (acc["at"] - 1).alias("last")))
    )
    return F.aggregate(segments, empty, step, last)


def plan_snippets(df: DataFrame, segments_col: str = "segments", max_duration: float = 600.0, min_duration: float = 0.5, max_gap: float = 30.0) -> DataFrame:
    """Add ``snippets`` (start, end, text, segments relative to the start) and how many were too long, too short or without text."""
    segs = F.col(segments_col)
    df = df.withColumn("__packed", F.transform(pack(segs, max_duration, max_gap), lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), F.slice(segs, p["first"] + 1, p["last"] - p["first"] + 1).alias("segments"),
        F.trim(F.array_join(F.transform(F.slice(segs, p["first"] + 1, p["last"] - p["first"] + 1), lambda x: F.trim(F.coalesce(x["text"], F.lit("")))), " ")).alias("text"),
    )))
    long = lambda p: p["end"] - p["start"] > max_duration
    short = lambda p: ~long(p) & (p["end"] - p["start"] < min_duration)
    mute = lambda p: ~long(p) & ~short(p) & (p["text"] == "")
    count = lambda test: F.size(F.filter("__packed", test))
    good = F.filter("__packed", lambda p: ~long(p) & ~short(p) & ~mute(p))
    moved = F.transform(good, lambda p: F.struct(p["start"], p["end"], p["text"], relative(p["segments"], p["start"], p["end"]).alias("segments")))
    return df.select("*", moved.alias("snippets"), count(long).alias("too_long"), count(short).alias("too_short"), count(mute).alias("no_text")).drop("__packed")


def relative(segments: Column, start: Column, end: Column) -> Column:
    """Segments with times counted from ``start``, clamped to the snippet."""
    inside = lambda t: F.least(F.greatest(end - start, F.lit(0.0)), F.greatest(F.lit(0.0), t.cast("double") - start))
    return F.transform(segments, lambda x: x.withField("start", inside(x["start"])).withField("end", inside(x["end"])))


def merge(segments: Column, gap: float = 0.0, least: float = 0.0) -> Column:
    """Spans merged where the next starts within ``gap`` of the last end; then those of at least ``least`` seconds."""
    zero = F.expr(f"cast(array() as {SPAN})")

    def step(acc: Column, x: Column) -> Column:
        s, e = x["start"].cast("double"), x["end"].cast("double")
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(last["start"].alias("start"), F.greatest(last["end"], e).alias("end")))
        return F.when((F.size(acc) > 0) & (s - last["end"] <= gap), grown).otherwise(F.array_append(acc, F.struct(s.alias("start"), e.alias("end"))))

    return F.filter(F.aggregate(_sorted(segments), zero, step), lambda x: x["end"] - x["start"] >= least)


def split_points(segments: Column, max_length: float = 3600.0) -> Column:
    """Ends of segments at which a long recording is cut, so that pieces stay under ``max_length`` where they can."""
    zero = F.expr("named_struct('cuts', cast(array() as array<double>), 'from', 0.0D, 'prev', 0.0D)")

    def step(acc: Column, x: Column) -> Column:
        e = x["end"].cast("double")
        cut = e - acc["from"] > max_length
        return F.struct(F.when(cut, F.array_append(acc["cuts"], acc["prev"])).otherwise(acc["cuts"]).alias("cuts"), F.when(cut, acc["prev"]).otherwise(acc["from"]).alias("from"), e.alias("prev"))

    return F.aggregate(_sorted(segments), zero, step, lambda acc: acc["cuts"])


def join_pieces(pieces: Column) -> Column:
    """One text and alignment of pieces ``struct<text,offset,words array<struct<word,start,end>>>``; times are shifted by the offset."""
    text = F.array_join(F.filter(F.transform(pieces, lambda p: F.trim(F.coalesce(p["text"], F.lit("")))), lambda t: t != ""), " ")
    words = F.flatten(F.transform(pieces, lambda p: F.transform(p["words"], lambda w: w.withField("start", F.round(w["start"] + p["offset"], 3)).withField("end", F.round(w["end"] + p["offset"], 3)))))
    return F.struct(text.alias("text"), words.alias("words"))


def concat_offsets(segments: Column, silence: float = 0.5) -> Column:
    """Where each segment lies (ms) in a recording of all of them with silence in between."""
    zero = F.expr("named_struct('at', 0L, 'out', cast(array() as array<struct<original_start_ms:bigint,original_end_ms:bigint,concat_start_ms:bigint,concat_end_ms:bigint>>))")

    def step(acc: Column, x: Column) -> Column:
        a, b = F.floor(x["start"] * 1000).cast("long"), F.floor(x["end"] * 1000).cast("long")
        item = F.struct(a.alias("original_start_ms"), b.alias("original_end_ms"), acc["at"].alias("concat_start_ms"), (acc["at"] + b - a).alias("concat_end_ms"))
        return F.struct((acc["at"] + b - a + int(silence * 1000)).alias("at"), F.array_append(acc["out"], item).alias("out"))

    return F.aggregate(segments, zero, step, lambda acc: acc["out"])


def to_original(mappings: Column, start_ms: Column, end_ms: Column) -> Column:
    """The original times of a range of a concatenated recording; null if it meets none or several of the mappings."""
    low = lambda m: F.greatest(m["concat_start_ms"], start_ms)
    high = lambda m: F.least(m["concat_end_ms"], end_ms)
    hit = F.filter(mappings, lambda m: low(m) < high(m))
    at = lambda m, t: m["original_start_ms"] + t - m["concat_start_ms"]
    spans = F.transform(hit, lambda m: F.struct(at(m, low(m)).alias("start_ms"), at(m, high(m)).alias("end_ms")))
    return F.when((end_ms > start_ms) & (F.size(hit) == 1), spans[0])


def words_to_segments(df: DataFrame, words_col: str = "alignment", segments_col: str = "segments") -> DataFrame:
    """Give each segment its words and text: a word goes where it lies, or to the one of two neighbours it overlaps more."""
    def assign(r: dict) -> dict:
        words = sorted(r[words_col] or [], key=lambda w: w["start"])
        segs = sorted(r[segments_col] or [], key=lambda s: s["start"])
        got: list[list[dict]] = [[] for _ in segs]
        share = lambda w, s: max(0.0, min(w["end"], s["end"]) - max(w["start"], s["start"]))
        k = 0
        for i, s in enumerate(segs):
            while k < len(words) and words[k]["start"] < s["end"]:
                w = words[k]
                inside = w["start"] >= s["start"] and w["end"] <= s["end"]
                later = share(w, segs[i + 1]) if i + 1 < len(segs) else 0.0
                if not inside and later > share(w, s):
                    break
                if inside or share(w, s) > 0:
                    got[i].append(w)
                k += 1
        return {"aligned": [{"start": s["start"], "end": s["end"], "speaker": s.get("speaker"), "text": " ".join(w["word"] for w in g), "words": g} for s, g in zip(segs, got)]}

    return by_row(df, assign, "aligned array<struct<start:double,end:double,speaker:string,text:string,words:array<struct<word:string,start:double,end:double>>>>")
