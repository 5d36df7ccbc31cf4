"""Operators on audio manifests: training windows, transcript filters, metrics, signal measures.

Speech models are passed in as functions; what is done with their output is here.
"""

from __future__ import annotations

import io
import operator
import wave
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import let, ngrams, strip, words

from .segments import NO_SPEAKER, by_row

_SEG = "struct<start:double,end:double,speaker:string,text:string,bandwidth:int>"
WINDOWS = (
    f"windows array<struct<segments:array<{_SEG}>,speaker_durations:array<double>>>, lost_sample_rate int, lost_bandwidth int, lost_window int, "
    "lost_speakers int, lost_no_speaker int, lost_next_bandwidth int, truncations int"
)


def compare(df: DataFrame, column: str, value, how: str = "eq") -> DataFrame:
    """Keep rows whose column is lt, le, eq, ne, ge or gt a constant."""
    if how not in {"lt", "le", "eq", "ne", "ge", "gt"}:
        raise ValueError(f"unknown comparison {how}")
    return df.where(getattr(operator, how)(F.col(column), F.lit(value)))


def keep_scores(df: DataFrame, least: Mapping[str, float | None]) -> DataFrame:
    """Keep rows whose scores (of injected models) reach all limits that are set."""
    for c, x in least.items():
        if x is not None:
            df = df.where(F.col(c) >= x)
    return df


def training_windows(df: DataFrame, duration: float = 120.0, tolerance: float = 0.1, min_bandwidth: int = 8000, min_sample_rate: int = 16000, min_speakers: int = 2, max_speakers: int = 5, truncation: bool = True) -> DataFrame:
    """From every segment grow a window of about ``duration`` seconds; add the valid ones and why others were lost.

    ``segments`` has start, end, speaker, text, bandwidth and words (word,
    start, end). Growth stops at low bandwidth, at too many speakers or at a
    segment of nobody; a segment over the limit is cut after its last whole
    word. Each row is a state machine of its own.
    """
    low, high = duration * (1 - tolerance), duration * (1 + tolerance)

    def people(segs) -> dict[str, float]:
        out: dict[str, float] = {}
        for s in segs:
            if s["speaker"]:
                out[s["speaker"]] = out.get(s["speaker"], 0.0) + s["end"] - s["start"]
        return out

    def crowded(segs) -> bool:
        p = people(segs)
        return len(p) > max_speakers or NO_SPEAKER in p

    def cut(s: dict, end: float) -> dict:
        w = [x for x in s.get("words") or [] if x["end"] <= end]
        return {**s, "text": " ".join(x["word"] for x in w if x["word"]), "end": w[-1]["end"] if w else s["start"]}

    def grow(segs: list[dict], first: int) -> tuple[list[dict], int, int]:
        """The window's segments, the segment that ended it, and cuts made."""
        got: list[dict] = []
        for k in range(first, len(segs)):
            s = segs[k]
            if (s["bandwidth"] or 0) < min_bandwidth:
                return got, k, 0
            if s["end"] - segs[first]["start"] > high:
                limit = segs[first]["start"] + high
                if not truncation or s["start"] >= limit:
                    return got, k, 0
                part = cut(s, limit)
                return (got if crowded([*got, part]) else [*got, part]), k, 1
            if crowded([*got, s]):
                return got, k, 0
            got.append(s)
        return got, len(segs) - 1, 0

    def build(r: dict) -> dict:
        segs, n, out = r["segments"] or [], Counter(), []
        if (r["audio_sample_rate"] or 0) < min_sample_rate:
            n["lost_sample_rate"] = len(segs)
            segs = []
        for i, s in enumerate(segs):
            if (s["bandwidth"] or 0) < min_bandwidth:
                n["lost_bandwidth"] += 1
                continue
            got, stop, cuts = grow(segs, i)
            n["truncations"] += cuts
            span = (got[-1]["end"] if got else s["end"]) - s["start"]
            if not low <= span <= high or len(got) < 2:
                n["lost_window"] += 1
                after = segs[min(stop, len(segs) - 1)]
                if (after["speaker"] or NO_SPEAKER) == NO_SPEAKER:
                    n["lost_no_speaker"] += 1
                elif (after["bandwidth"] or 0) < min_bandwidth:
                    n["lost_next_bandwidth"] += 1
                continue
            p = people(got)
            if not min_speakers <= len(p) <= max_speakers:
                n["lost_speakers"] += 1
                continue
            longest = sorted(p.values(), reverse=True)[:5]
            out.append({"segments": [{k: x[k] for k in ("start", "end", "speaker", "text", "bandwidth")} for x in got], "speaker_durations": longest + [0.0] * (5 - len(longest))})
        return {"windows": out, **{k: n[k] for k in ("lost_sample_rate", "lost_bandwidth", "lost_window", "lost_speakers", "lost_no_speaker", "lost_next_bandwidth", "truncations")}}

    return by_row(df, build, WINDOWS)


def filter_windows(df: DataFrame, overlap_percent: float = 0.0, target: float = 120.0, windows_col: str = "windows") -> DataFrame:
    """Of windows that overlap, keep the ones nearer to the target duration; add ``kept_windows`` (indexes) and ``kept_duration``.

    Overlap counts against the shorter one. Of two that conflict the farther
    from the target goes; of equally far ones the shorter, and then the later.
    """
    least = overlap_percent / 100

    def choose(r: dict) -> dict:
        spans = [(w["segments"][0]["start"], w["segments"][-1]["end"], i) for i, w in enumerate(r[windows_col] or []) if w["segments"]]
        spans.sort()
        gone: set[int] = set()
        for a, (s1, e1, _) in enumerate(spans):
            if a in gone:
                continue
            for b in range(a + 1, len(spans)):
                s2, e2, _ = spans[b]
                if s2 >= e1:
                    break
                small = min(e1 - s1, e2 - s2)
                ratio = max(0.0, min(e1, e2) - max(s1, s2)) / small if small else 0.0
                if b in gone or ratio < least:
                    continue
                far1, far2 = abs(e1 - s1 - target), abs(e2 - s2 - target)
                if far1 < far2 or far1 == far2 and e1 - s1 >= e2 - s2:
                    gone.add(b)
                else:
                    gone.add(a)
                    break
        kept = [x for k, x in enumerate(spans) if k not in gone]
        return {"kept_windows": sorted(i for _, _, i in kept), "kept_duration": float(sum(e - s for s, e, _ in kept))}

    return by_row(df, choose, "kept_windows array<int>, kept_duration double")


def hallucination(text: Column, duration: Column, language: Column, phrases: list[str], unique_share: float = 0.4, long_word: int = 25, long_word_compounding: int = 35, long_word_jump: float = 3.0, max_char_rate: float = 40.0, compounding: tuple[str, ...] = ("de", "fi", "hu", "tr", "et", "nl", "sv", "da", "no")) -> Column:
    """Why a transcript looks made up: ``repeated_ngrams``, ``long_word``, ``phrase_match``, ``high_char_rate``; empty if it doesn't, null without text."""
    bare = lambda s: "".join(c for c in s.strip() if c not in ".?!,")
    known = sorted({bare(p) for p in phrases if p.strip()})
    w = words(text)
    sizes = F.array_sort(F.transform(w, F.length))
    top, second = F.try_element_at(sizes, F.lit(-1)), F.try_element_at(sizes, F.lit(-2))
    joins = F.coalesce(F.lower(F.trim(language)).isin(*compounding), F.lit(False))
    long = F.when(joins, top >= long_word_compounding).otherwise((top >= long_word) | F.coalesce((second > 0) & ((top - second) / second >= long_word_jump), F.lit(False)))
    clean = F.translate(strip(text), ".?!,", "")
    forms = F.array(clean, F.translate(clean, "-", " "))
    phrase = F.exists(forms, lambda f: f.isin(*known)) if known else F.lit(False)
    for p in known:
        if len(p) >= 8:
            phrase = phrase | F.startswith(forms[0], F.lit(p)) | F.startswith(forms[1], F.lit(p))
    chars = F.length(F.array_join(w, ""))
    rate = (duration > 0) & (chars / duration > max_char_rate)
    repeated = F.size(F.array_distinct(w)) / F.size(w) <= unique_share
    hits = ((repeated, "repeated_ngrams"), (long, "long_word"), (phrase, "phrase_match"), (rate, "high_char_rate"))
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in hits)))
    return F.when(F.size(w) > 0, reasons)


def flag_hallucinations(df: DataFrame, phrases: list[str], text_col: str = "pred_text", skip_col: str = "_skipme", duration_col: str = "duration", language_col: str = "language", overwrite: bool = False, name: str = "hallucination", **limits) -> DataFrame:
    """Set the skip flag of made-up transcripts and add a note; flagged rows are left alone unless ``overwrite``."""
    flag, why = F.coalesce(F.col(skip_col), F.lit("")), hallucination(F.col(text_col), F.col(duration_col), F.col(language_col), phrases, **limits)
    df = df.withColumn("__why", why)
    bad, was = F.size("__why") > 0, F.startswith(flag, F.lit("Hallucination"))
    skipped = F.lit(False) if overwrite else flag != ""
    new = F.when(skipped | F.col("__why").isNull(), flag).when(bad & (was | (flag == "")), f"Hallucination:{name}").when(~bad & was, "").otherwise(flag)
    note = F.when(skipped, "skipped (flagged)").when(F.col("__why").isNull(), "skipped (empty text)").when(bad, F.concat(F.lit("hallucination ("), F.array_join("__why", ", "), F.lit(")"))).when(was, "recovered").otherwise("passed")
    return df.withColumn("note", note).withColumn(skip_col, new).drop("__why")


def repeats_ngram(text: Column, n: int = 10, most: int = 3) -> Column:
    """Whether some n-gram of words occurs more than ``most`` times: equal ones are neighbours once sorted."""
    def repeats(g: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(g) - most, F.lit(1)))
        return (F.size(g) > most) & F.exists(starts, lambda i: F.coalesce(F.try_element_at(g, i) == F.try_element_at(g, i + most), F.lit(False)))

    return let(F.array_sort(F.coalesce(ngrams(text, n), F.expr("cast(array() as array<string>)"))), repeats)


def histogram(df: DataFrame, column: str = "duration", width: float = 30.0) -> DataFrame:
    """(bin, start, n): rows a bin, from 0 to the last bin that has any, without gaps."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = counts.agg(F.max("bin").alias("m")).where("m IS NOT NULL").select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("m", F.lit(0)))).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", (F.col("bin") * width).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def snippet_id(original: Column, start: Column, end: Column) -> Column:
    """An id with bounds in milliseconds; what a path may not hold becomes ``_``."""
    ms = lambda t: F.round(t * 1000).cast("long").cast("string")
    return F.concat_ws("_", F.translate(original, '/\\:*?"<>| ', "_" * 10), ms(start), ms(end))


def module_segments(df: DataFrame, module: str = "tts", min_duration: float = 5.0, max_duration: float = 20.0, max_pause: float = 2.0, marks: str = ".!?。？！", segments_col: str = "aligned") -> DataFrame:
    """Cut words anew into ``prepared`` segments for synthesis (one speaker each) or recognition.

    Sentences that end in a terminal mark are joined while they are short; what
    is longer than the limit is cut by duration and, for synthesis, at pauses.
    The limit is the same for all rows, so results don't depend on chance.
    """
    def by_duration(ws: list[dict]) -> list[list[dict]]:
        out, now = [], []
        for w in ws:
            if now:
                span = now[-1]["end"] - now[0]["start"]
                pause = module == "tts" and w["start"] - now[-1]["end"] > max_pause and span >= min_duration
                if w["end"] - now[0]["start"] > max_duration or pause:
                    out.append(now)
                    now = []
            now.append(w)
        return [*out, now] if now else out

    def by_sentence(ws: list[dict]) -> list[list[dict]]:
        ends = [i for i, w in enumerate(ws) if w["word"] and w["word"][-1] in marks]
        out, first, k = [], 0, 0
        while k < len(ends):
            span = lambda j: ws[ends[j]]["end"] - ws[first]["start"]
            last = k
            if span(k) < min_duration:
                while last + 1 < len(ends) and span(last + 1) <= max_duration:
                    last += 1
            part = ws[first : ends[last] + 1]
            out += by_duration(part) if part[-1]["end"] - part[0]["start"] > max_duration else [part]
            first, k = ends[last] + 1, last + 1
        return out + by_duration(ws[first:])

    def prepare(r: dict) -> dict:
        ws = [{**w, "speaker": s["speaker"]} for s in sorted(r[segments_col] or [], key=lambda s: s["start"]) for w in s["words"] or []]
        groups: list[list[dict]] = []
        for w in ws:
            if groups and (module != "tts" or groups[-1][-1]["speaker"] == w["speaker"]):
                groups[-1].append(w)
            else:
                groups.append([w])
        if module == "tts":
            groups = [g for g in groups if g[0]["speaker"] not in (None, NO_SPEAKER)]
        out = [p for g in groups for p in by_sentence(g) if min_duration <= p[-1]["end"] - p[0]["start"] <= max_duration]
        return {"prepared": [{"speaker": ",".join(dict.fromkeys(w["speaker"] or NO_SPEAKER for w in p)), "start": p[0]["start"], "end": p[-1]["end"], "text": " ".join(w["word"] for w in p)} for p in out]}

    return by_row(df, prepare, "prepared array<struct<speaker:string,start:double,end:double,text:string>>")


def _wave(raw: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(raw)) as w:
        n, width = w.getnchannels(), w.getsampwidth()
        kind = {1: np.uint8, 2: np.int16, 4: np.int32}[width]
        x = np.frombuffer(w.readframes(w.getnframes()), dtype=kind).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
        return x.reshape(-1, n), w.getframerate()


@F.pandas_udf(T.StructType([T.StructField("duration", T.DoubleType()), T.StructField("sample_rate", T.IntegerType()), T.StructField("channels", T.IntegerType())]))
def wave_info(content: pd.Series) -> pd.DataFrame:
    """Duration, rate and channels from a WAV file's header; nulls where it isn't one."""
    rows = []
    for raw in content:
        try:
            with wave.open(io.BytesIO(raw)) as w:
                rows.append((w.getnframes() / w.getframerate(), w.getframerate(), w.getnchannels()))
        except (wave.Error, EOFError, TypeError, ZeroDivisionError):
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["duration", "sample_rate", "channels"])


@F.pandas_udf(T.BinaryType())
def to_mono(content: pd.Series) -> pd.Series:
    """A 16-bit WAV file of the mean of all channels; null where it isn't a WAV file."""
    def one(raw):
        try:
            x, rate = _wave(raw)
        except (wave.Error, EOFError, TypeError, KeyError):
            return None
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes(np.clip(np.round(x.mean(axis=1) * 32767), -32768, 32767).astype("<i2").tobytes())
        return out.getvalue()

    return content.map(one)


def bandwidth(content: Column, n_fft: int = 512, stride: float = 0.01, top_db: float = 100.0, threshold: float = -50.0) -> Column:
    """The highest frequency whose level, averaged over frames, is within ``threshold`` dB of the loudest; null if it isn't a WAV file."""
    @F.pandas_udf("int")
    def measure(raws: pd.Series) -> pd.Series:
        def one(raw):
            try:
                x, rate = _wave(raw)
            except (wave.Error, EOFError, TypeError, KeyError):
                return None
            x = x.mean(axis=1)
            hop = max(1, int(rate * stride))
            if len(x) < n_fft:
                x = np.pad(x, (0, n_fft - len(x)))
            frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
            level = np.zeros(n_fft // 2 + 1)
            for i in range(0, len(frames), 1000):
                level += (np.abs(np.fft.rfft(frames[i : i + 1000] * np.hanning(n_fft), axis=1)) ** 2).sum(axis=0)
            db = 10 * np.log10(np.maximum(level / max(len(frames), 1), 1e-20))
            db = np.maximum(db - db.max(), -top_db)
            return int(np.flatnonzero(db > threshold).max() * rate / n_fft)

        return raws.map(one)

    return measure(content)


__all__ = ["bandwidth", "compare", "filter_windows", "flag_hallucinations", "hallucination", "histogram", "keep_scores", "module_segments", "repeats_ngram", "snippet_id", "to_mono", "training_windows", "wave_info"]
