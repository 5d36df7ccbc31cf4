"""Images, clips, recordings and pages around injected decoders and models.

A decoder, encoder or model is a factory as in ``operators.models``: run once in
each Python worker, it gives a function from a list of inputs to a list of
results. An input may be a struct (a dict in the list). What Spark or numpy can
say is said here: spans, paths, thresholds, WAV files, rows and their order.
Null inputs don't reach a model and give nulls.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .audio import _wave
from .interleaved import align, place_floaters
from .models import Factory, infer
from .segments import join_pieces, merge
from .synthetic import generate

SPANS = "array<struct<start:double,end:double>>"
ELEMENTS = "array<struct<kind:string,text:string,y:double,floating:boolean>>"


def apply(df: DataFrame, factory: Factory, fields: str, inputs: Sequence[str] | str, **options) -> DataFrame:
    """Add the fields of the struct that a model gives for one column, or for several as a dict."""
    df = df.withColumn("__in", F.col(inputs) if isinstance(inputs, str) else F.struct(*inputs))
    out = infer(df, factory, "__out", f"struct<{fields}>", "__in", sort_by_length=False, **options)
    names = [f.name for f in out.schema["__out"].dataType.fields]
    return out.select(*(c for c in df.columns if c != "__in" and c not in names), "__out.*")


# --- images


def decoded_images(df: DataFrame, factory: Factory, content_col: str = "content") -> DataFrame:
    """Images that can be decoded, with ``width``, ``height`` and an id; ``factory`` gives (width, height) as a dict, or None."""
    out = apply(df, factory, "width int, height int", content_col)
    return out.where("width IS NOT NULL").withColumn("image_id", F.substring(F.sha2("path", 256), 1, 16))


def score_images(df: DataFrame, factory: Factory, field: str, input_col: str = "embedding", least: float | None = None, below: float | None = None) -> DataFrame:
    """Add a score of each image or embedding and keep those of at least ``least`` (aesthetics) or under ``below`` (unsafe content)."""
    df = infer(df, factory, field, "double", input_col, sort_by_length=False)
    ok = F.lit(True)
    if least is not None:
        ok = ok & (F.col(field) >= least)
    if below is not None:
        ok = ok & (F.col(field) < below)
    return df.where(ok)


def images_to_documents(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Image rows as documents: the columns named, under their new names, without bytes."""
    return df.select(*(F.col(old).alias(new) for old, new in fields.items()))


# --- clips


def transcoded_clips(df: DataFrame, factory: Factory, file_col: str = "file", content_col: str = "content", spans_col: str = "spans", least: float = 0.0) -> DataFrame:
    """One row a span of at least ``least`` seconds: ``clip_id``, its bounds and its encoded bytes; spans that can't be encoded go.

    ``factory`` takes (content, span_start, span_end).
    """
    rows = df.select("*", F.explode(spans_col).alias("__s")).select("*", F.col("__s.start").alias("span_start"), F.col("__s.end").alias("span_end")).drop("__s", spans_col)
    rows = rows.where(F.col("span_end") - F.col("span_start") >= least)
    named = rows.withColumn("clip_id", F.substring(F.sha2(F.concat_ws("|", file_col, F.col("span_start").cast("string"), F.col("span_end").cast("string")), 256), 1, 32))
    return apply(named, factory, "clip binary", [content_col, "span_start", "span_end"]).where("clip IS NOT NULL").drop(content_col)


def extracted_frames(df: DataFrame, factory: Factory, content_col: str = "clip", times: Column | None = None) -> DataFrame:
    """Add ``frames``: the encoded pictures at the times asked for; ``factory`` takes (content, times)."""
    return apply(df.withColumn("__times", times), factory, "frames array<binary>", [content_col, "__times"]).drop("__times")


def motion_scores(df: DataFrame, factory: Factory, content_col: str = "clip") -> DataFrame:
    """Add ``motion_mean`` and ``motion_patch_min`` from motion vectors that an injected decoder finds."""
    return apply(df, factory, "motion_mean double, motion_patch_min double", content_col)


def captions(df: DataFrame, factory: Factory, prompt: str, window: int = 8, frames_col: str = "frames") -> DataFrame:
    """One row a window of up to ``window`` frames, with what a model says of it; ``factory`` takes (frames, prompt)."""
    n = F.ceil(F.size(frames_col) / window).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(frames_col, i * window + 1, F.lit(window)))
    rows = df.where(F.size(frames_col) > 0).select("*", F.posexplode(cut).alias("window_id", "__frames")).drop(frames_col).withColumn("__prompt", F.lit(prompt))
    rows = rows.withColumnRenamed("__frames", "frames").withColumnRenamed("__prompt", "prompt")
    return apply(rows, factory, "caption string", ["frames", "prompt"]).drop("frames", "prompt")


def enhanced_captions(df: DataFrame, factory: Factory, prompt: str = "Say the same in one clear paragraph.\n\n{document}") -> DataFrame:
    return generate(df, factory, prompt, "caption", "enhanced_caption")


def previews(df: DataFrame, factory: Factory, frames_col: str = "frames") -> DataFrame:
    """Add ``preview``: one moving picture of the frames."""
    return apply(df, factory, "preview binary", frames_col)


# --- recordings


def _file(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1]), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.clip(np.round(x * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def resampled(content: Column, rate: int) -> Column:
    """A 16-bit WAV file at another rate, band-limited by its spectrum; null where it isn't a WAV file."""
    @F.pandas_udf(T.BinaryType())
    def run(raws: pd.Series) -> pd.Series:
        def one(raw):
            try:
                x, old = _wave(raw)
            except (wave.Error, EOFError, TypeError, KeyError):
                return None
            n = round(len(x) * rate / old)
            spectrum = np.fft.rfft(x, axis=0)
            size = n // 2 + 1
            spectrum = spectrum[:size] if len(spectrum) >= size else np.pad(spectrum, ((0, size - len(spectrum)), (0, 0)))
            return _file(np.fft.irfft(spectrum, n, axis=0) * (n / max(1, len(x))) if n else x[:0], rate)

        return raws.map(one)

    return run(content)


@F.pandas_udf(T.BinaryType())
def cut_wave(content: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """The part of a WAV file between two times in seconds; null where it isn't one or a time is missing."""
    def one(raw, a, b):
        try:
            x, rate = _wave(raw)
        except (wave.Error, EOFError, TypeError, KeyError):
            return None
        if pd.isna(a) or pd.isna(b):
            return None
        return _file(x[max(0, round(a * rate)) : max(0, round(b * rate))], rate)

    return pd.Series([one(*z) for z in zip(content, start, end)], dtype=object)


def cut_segments(df: DataFrame, segments_col: str = "segments", content_col: str = "content", least: float = 0.0) -> DataFrame:
    """One row a segment of at least ``least`` seconds with its own recording; the other fields of the segment become columns."""
    rows = df.select("*", F.posexplode(segments_col).alias("segment_num", "__s")).drop(segments_col).where(F.col("__s.end") - F.col("__s.start") >= least)
    return rows.withColumn(content_col, cut_wave(F.col(content_col), F.col("__s.start").cast("double"), F.col("__s.end").cast("double"))).select(*(c for c in rows.columns if c != "__s"), "__s.*")


def speech_segments(content: Column, frame: float = 0.02, threshold: float = 0.01, gap: float = 0.1, least: float = 0.1) -> Column:
    """Spans whose frames' level (root mean square) reaches a threshold, joined over short gaps; a stand-in for a trained detector."""
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])))
    def loud(raws: pd.Series) -> pd.Series:
        def one(raw):
            try:
                x, rate = _wave(raw)
            except (wave.Error, EOFError, TypeError, KeyError):
                return None
            n = max(1, round(rate * frame))
            x = x.mean(axis=1)
            x = np.pad(x, (0, -len(x) % n)).reshape(-1, n)
            on = np.concatenate([[False], np.sqrt((x * x).mean(axis=1)) >= threshold, [False]])
            edge = np.flatnonzero(on[1:] != on[:-1])
            return [{"start": a * n / rate, "end": b * n / rate} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]

        return raws.map(one)

    return merge(loud(content), gap, least)


def by_model(df: DataFrame, factory: Factory, field: str, kind: str, content_col: str = "content") -> DataFrame:
    """Add what a model hears in a recording: ``string`` for transcripts, spans for voices, speakers or events."""
    return infer(df, factory, field, kind, content_col, sort_by_length=False)


def events_over(probabilities: Column, seconds: float, threshold: float = 0.5) -> Column:
    """Spans of consecutive frames of ``seconds`` whose probability of an event reaches the threshold."""
    on = F.filter(F.transform(probabilities, lambda p, i: F.when(p >= threshold, F.struct((i * seconds).alias("start"), ((i + 1) * seconds).alias("end")))), lambda x: x.isNotNull())
    return merge(on, 1e-9)


def by_speaker(df: DataFrame, key: Sequence[str], segments_col: str = "segments") -> DataFrame:
    """One row a speaker of a recording: segments in order and their seconds."""
    s = df.select(*key, F.explode(segments_col).alias("s"))
    length = F.sum(F.col("s.end") - F.col("s.start")).alias("seconds")
    return s.groupBy(*key, F.col("s.speaker").alias("speaker")).agg(F.array_sort(F.collect_list(F.struct("s.start", "s.end"))).alias("segments"), length)


def transcribed_in_pieces(df: DataFrame, factory: Factory, key: Sequence[str], cuts: Column, duration: Column, content_col: str = "content") -> DataFrame:
    """Long recordings cut at the given times, each piece heard by a model, texts and word times joined again.

    ``factory`` gives (text, words) of a recording; a word has its time in its piece.
    """
    ends = F.concat(F.array(F.lit(0.0)), cuts, F.array(duration.cast("double")))
    spans = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.struct(F.element_at(ends, i).alias("start"), F.element_at(ends, i + 1).alias("end")))
    pieces = cut_segments(df.select(*key, content_col, spans.alias("segments")), content_col=content_col)
    heard = apply(pieces, factory, "text string, words array<struct<word:string,start:double,end:double>>", content_col)
    piece = F.struct("segment_num", "text", F.col("start").alias("offset"), "words")
    return heard.groupBy(*key).agg(F.array_sort(F.collect_list(piece)).alias("p")).select(*key, join_pieces(F.col("p")).alias("x")).select(*key, "x.*")


def rewritten(df: DataFrame, factory: Factory, text_col: str = "text", out: str | None = None) -> DataFrame:
    """Texts rewritten by an injected rule: spoken numbers as digits, one script as another."""
    made = infer(df, factory, "__t", "string", text_col)
    return made.withColumn(out or text_col, F.col("__t")).drop("__t")


# --- pages


def page_images(df: DataFrame, factory: Factory, key: str = "file_name", content_col: str = "content") -> DataFrame:
    """One row a page that an injected renderer makes of a file: ``page``, ``image``."""
    made = infer(df.select(key, content_col), factory, "__pages", "array<binary>", content_col, sort_by_length=False)
    return made.select(key, F.posexplode("__pages").alias("page", "image"))


def parsed_pages(pages: DataFrame, factory: Factory) -> DataFrame:
    """Add ``elements`` (kind, text, height on the page, whether it floats) that a model reads off a page's image."""
    return infer(pages, factory, "elements", ELEMENTS, "image", sort_by_length=False)


def page_rows(parsed: DataFrame, key: str = "file_name") -> DataFrame:
    """Elements of all pages as interleaved rows, floating ones beside the text that is nearest; pages follow each other."""
    e = parsed.select(F.col(key).alias("sample_id"), "page", F.posexplode("elements").alias("item", "e"))
    placed = place_floaters(e.select(F.concat_ws("\x1f", "sample_id", "page").alias("page"), "item", F.col("e.floating").alias("floating"), F.col("e.y").alias("y"), "sample_id", F.col("page").alias("number"), F.col("e.kind").alias("kind"), F.col("e.text").alias("text")))
    place = F.row_number().over(_order("sample_id", "number", "place")) - 1
    picture = F.col("kind") == "picture"
    rows = placed.select("sample_id", place.cast("int").alias("position"), F.when(picture, "image").otherwise("text").alias("modality"), F.when(~picture, F.col("text")).alias("text_content"))
    return align(rows)


def _order(key: str, *by: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*by)


# --- made rows and their scores


def designed_rows(spark: SparkSession, n: int, columns: Sequence[Mapping], models: Mapping[str, Factory], seed: int = 0) -> DataFrame:
    """``n`` rows from column specs, in order: {"name", "values"} drawn by a seeded hash, {"name", "expr"} SQL, {"name", "model", "prompt"} with ``{column}`` places."""
    df = spark.range(n)
    for k, c in enumerate(columns):
        if "values" in c:
            drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(len(c["values"]))) + 1
            df = df.withColumn(c["name"], F.element_at(F.array(*map(F.lit, c["values"])), drawn.cast("int")))
        elif "expr" in c:
            df = df.withColumn(c["name"], F.expr(c["expr"]))
        else:
            prompt = F.lit(c["prompt"])
            for name in df.columns:
                prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
            df = infer(df.withColumn("__prompt", prompt), models[c["model"]], c["name"], "string", "__prompt").drop("__prompt")
    return df


def translation_scores(df: DataFrame, factory: Factory, field: str = "quality", source_col: str = "text", output_col: str = "translated_text", least: float | None = None) -> DataFrame:
    """Add an injected metric of (source, translation); keep rows of at least ``least``."""
    out = apply(df, factory, f"{field} double", [source_col, output_col])
    return out if least is None else out.where(F.col(field) >= least)
