"""Queries of image, clip, recording and page operators; decoders and models are stand-ins whose answers SQL states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.session import read_table, spread
from millrace.operators import audio, interleaved, media, video

from .base import query
from .io_queries import _wav


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a part: its name as bytes."""
    p = spread(read_table(spark, sf_dir, "part"))
    return p.select("p_partkey", "p_size", F.concat(F.lit("/in/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").cast("binary").alias("content"))


# --- images


def _sizes():
    return lambda batch: [{"width": len(x), "height": 2 * len(x)} if len(x) % 2 == 0 else None for x in batch]


@query("decoded_images", "SELECT sha256('/in/' || p_partkey)[1:16] AS image_id, length(p_name)::INT AS width, (2 * length(p_name))::INT AS height FROM part WHERE length(p_name) % 2 = 0")
def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of odd length can't be decoded and go."""
    return media.decoded_images(_parts(spark, sf_dir), _sizes).select("image_id", "width", "height")


@query("aesthetic_images", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND embedding[1]::DOUBLE >= 0.05")
def aesthetic_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return media.score_images(e, lambda: lambda batch: [float(x[0]) for x in batch], "aesthetic_score", least=0.05).select("vec_id")


@query("safe_images", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND embedding[2]::DOUBLE < 0.1")
def safe_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return media.score_images(e, lambda: lambda batch: [float(x[1]) for x in batch], "nsfw_score", below=0.1).select("vec_id")


@query("images_to_documents", "SELECT '/in/' || p_partkey AS image_path, p_size AS score FROM part")
def images_to_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.images_to_documents(_parts(spark, sf_dir), {"path": "image_path", "p_size": "score"})


# --- clips


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans a part, of p_size / 10 seconds and of one; a stand-in encoder that names the span."""
    span = lambda a, b: F.struct(F.lit(a).alias("start"), b.alias("end"))
    df = _parts(spark, sf_dir).withColumn("file", F.col("path")).withColumn("spans", F.array(span(0.0, F.col("p_size") / 10), span(9.0, F.lit(10.0))))
    encode = lambda: lambda batch: [{"clip": x["content"] + f"@{x['span_start']:.1f}".encode()} for x in batch]
    return media.transcoded_clips(df, encode, least=1.0)


@query("transcoded_clips", """
WITH s AS (SELECT p_partkey, p_name, unnest([0.0, 9.0])::DOUBLE AS a, unnest([p_size / 10, 10.0])::DOUBLE AS b FROM part)
SELECT p_partkey, sha256('/in/' || p_partkey || '|' || a::VARCHAR || '|' || b::VARCHAR)[1:32] AS clip_id, md5(p_name || '@' || a::VARCHAR) AS h FROM s WHERE b - a >= 1""")  # fmt: skip
def transcoded_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clips(spark, sf_dir).select("p_partkey", "clip_id", F.md5("clip").alias("h"))


@query("clip_frames", "SELECT p_partkey, unnest([0.0, 2.0, 4.0])::DOUBLE AS at, md5(p_name || unnest(['0.0', '2.0', '4.0'])) AS h FROM part")
def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at two-second steps of five seconds' stamps."""
    stamps = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i / F.lit(2.0))
    decode = lambda: lambda batch: [{"frames": [x["content"] + f"{t:.1f}".encode() for t in x["__times"]]} for x in batch]
    got = media.extracted_frames(_parts(spark, sf_dir), decode, "content", F.filter(stamps, lambda t: t % 2 == 0))
    return got.select("p_partkey", F.posexplode("frames").alias("i", "f")).select("p_partkey", (F.col("i") * 2.0).alias("at"), F.md5("f").alias("h"))


@query("motion_scores", "SELECT p_partkey FROM part WHERE length(p_name) / 10000.0 >= 0.00098")
def motion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion by a stand-in decoder, then the filter on it."""
    decode = lambda: lambda batch: [{"motion_mean": len(x) / 10000.0, "motion_patch_min": 1.0} for x in batch]
    return video.motion_filter(media.motion_scores(_parts(spark, sf_dir), decode, "content")).select("p_partkey")


@query("clip_embeddings", "SELECT p_partkey, round((3.0 / sqrt(9.0 + p_size * p_size))::FLOAT::DOUBLE, 5) AS x FROM part")
def clip_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clip's embedding from its frames, at length 1."""
    from millrace.operators import models

    frames = F.transform(F.sequence(F.lit(1), "p_size"), lambda i: i.cast("string").cast("binary"))
    got = models.embed(_parts(spark, sf_dir).withColumn("frames", frames), lambda: lambda batch: [[3.0, float(len(x))] for x in batch], input_col="frames", sort_by_length=False)
    return got.select("p_partkey", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"))


@query("clip_captions", """
WITH w AS (SELECT p_partkey, p_size, unnest(range(0, (p_size + 7) // 8)) AS w FROM part)
SELECT p_partkey, w::INT AS window_id, 'Describe. ' || least(8, p_size - 8 * w) || ' frames' AS caption, upper('Better: Describe. ' || least(8, p_size - 8 * w) || ' frames') AS enhanced_caption FROM w""")  # fmt: skip
def clip_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of eight frames, a stand-in that counts them, and its captions written anew."""
    frames = F.transform(F.sequence(F.lit(1), "p_size"), lambda i: i.cast("string").cast("binary"))
    tell = lambda: lambda batch: [{"caption": f"{x['prompt']} {len(x['frames'])} frames"} for x in batch]
    got = media.captions(_parts(spark, sf_dir).withColumn("frames", frames), tell, "Describe.")
    better = media.enhanced_captions(got, lambda: lambda batch: [t.upper() for t in batch], "Better: {document}")
    return better.select("p_partkey", "window_id", "caption", "enhanced_caption")


@query("clip_previews", "SELECT p_partkey, md5(string_agg(i::VARCHAR, '' ORDER BY i)) AS h FROM (SELECT p_partkey, unnest(range(1, p_size + 1)) AS i FROM part) GROUP BY p_partkey")
def clip_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = F.transform(F.sequence(F.lit(1), "p_size"), lambda i: i.cast("string").cast("binary"))
    got = media.previews(_parts(spark, sf_dir).withColumn("frames", frames), lambda: lambda batch: [{"preview": b"".join(x)} for x in batch])
    return got.select("p_partkey", F.md5("preview").alias("h"))


# --- recordings


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording a part: p_size hundredths of a second at 8 kHz, one channel, silent."""
    return spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", "p_size", _wav(F.col("p_size") * 80, 1, 8000).alias("content"))


@query("resampled_audio", "SELECT p_partkey, 16000 AS sample_rate, p_size / 100.0 AS duration FROM part")
def resampled_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _recordings(spark, sf_dir).withColumn("info", audio.wave_info(media.resampled(F.col("content"), 16000)))
    return df.select("p_partkey", "info.sample_rate", "info.duration")


@query("cut_segments", "SELECT p_partkey, unnest([0, 1])::INT AS segment_num, unnest(['a', 'b']) AS speaker, unnest([0.1, round(p_size / 100.0 - 0.1, 9)])::DOUBLE AS duration FROM part WHERE p_size >= 20 UNION ALL SELECT p_partkey, 0, 'a', 0.1::DOUBLE FROM part WHERE p_size BETWEEN 10 AND 19")
def cut_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tenth of a second and the rest, where each has a tenth at least."""
    seg = lambda a, b, who: F.struct(a.alias("start"), b.alias("end"), F.lit(who).alias("speaker"))
    df = _recordings(spark, sf_dir).where("p_size >= 10").withColumn("segments", F.array(seg(F.lit(0.0), F.lit(0.1), "a"), seg(F.lit(0.1), F.col("p_size") / 100, "b")))
    cut = media.cut_segments(df, least=0.0999)
    return cut.select("p_partkey", "segment_num", "speaker", F.round(audio.wave_info("content")["duration"], 9).alias("duration"))


def _loud(frames, before: int, rate: int):
    """A WAV file of ``before`` silent frames, then constant ones."""
    return _wav(frames + before, 1, rate, F.lit(before), "FF3F")


@query("speech_segments", "SELECT p_partkey, 0.5::DOUBLE AS start, round(0.5 + (p_size * 10) * 0.02, 9)::DOUBLE AS stop FROM part")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a second of silence, then a loud part of whole frames."""
    df = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", _loud(F.col("p_size") * 10 * 40, 1000, 2000).alias("content"))
    s = df.select("p_partkey", F.explode(media.speech_segments(F.col("content"))).alias("s"))
    return s.select("p_partkey", F.round("s.start", 9).alias("start"), F.round("s.end", 9).alias("stop"))


@query("transcribed_audio", "SELECT p_partkey, 'heard ' || (44 + 160 * p_size) || ' bytes' AS pred_text FROM part")
def transcribed_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.by_model(_recordings(spark, sf_dir), lambda: lambda batch: [f"heard {len(x)} bytes" for x in batch], "pred_text", "string").select("p_partkey", "pred_text")


@query("transcribed_pieces", "SELECT p_partkey, CASE WHEN p_size > 10 THEN '1644 ' || (44 + 160 * (p_size - 10)) ELSE (44 + 160 * p_size)::VARCHAR END AS text, CASE WHEN p_size > 10 THEN 0.1 ELSE 0.0 END::DOUBLE AS last_start FROM part")
def transcribed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings cut after a tenth of a second, heard piece by piece, joined with shifted times."""
    hear = lambda: lambda batch: [{"text": str(len(x)), "words": [{"word": str(len(x)), "start": 0.0, "end": 0.05}]} for x in batch]
    cuts = F.when(F.col("p_size") > 10, F.array(F.lit(0.1))).otherwise(F.expr("cast(array() as array<double>)"))
    df = _recordings(spark, sf_dir)
    got = media.transcribed_in_pieces(df, hear, ["p_partkey"], cuts, F.col("p_size") / 100)
    return got.select("p_partkey", "text", F.array_max(F.transform("words", lambda w: w["start"])).alias("last_start"))


@query("diarized_audio", "SELECT p_partkey, unnest(['s0', 's1']) AS speaker, unnest([1.0, p_size::DOUBLE]) AS seconds FROM part")
def diarized_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers by a stand-in, and one row each."""
    hear = lambda: lambda batch: [[{"start": 0.0, "end": 1.0, "speaker": "s0"}, {"start": 2.0, "end": 2.0 + (len(x) - 44) / 160, "speaker": "s1"}] for x in batch]
    found = media.by_model(_recordings(spark, sf_dir), hear, "segments", "array<struct<start:double,end:double,speaker:string>>")
    return media.by_speaker(found, ["p_partkey"]).select("p_partkey", "speaker", F.round("seconds", 6).alias("seconds"))


@query("sound_events", "SELECT p_partkey, 0.5::DOUBLE AS start, 1.5::DOUBLE AS stop FROM part WHERE p_size >= 4")
def sound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from probabilities of half-second frames, of which the second and third are likely in longer recordings."""
    hear = lambda: lambda batch: [[0.1, 0.9, 0.8, 0.2] if len(x) >= 44 + 640 else [0.1] for x in batch]
    found = media.by_model(_recordings(spark, sf_dir), hear, "p", "array<double>")
    return found.select("p_partkey", F.explode(media.events_over(F.col("p"), 0.5)).alias("s")).select("p_partkey", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("written_numbers", "SELECT doc_id, replace(lang, 'e', '3') AS text FROM documents WHERE lang IS NOT NULL")
def written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through an injected rule of writing."""
    df = read_table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("text"))
    return media.rewritten(df, lambda: lambda batch: [t.replace("e", "3") for t in batch])


# --- pages


@query("parsed_pages", """
WITH e AS (SELECT s_suppkey, page, unnest([0, 1, 2]) AS item, unnest(['head ', 'pic ', 'body ']) || s_suppkey || '/' || page AS t FROM (SELECT s_suppkey, unnest([0, 1]) AS page FROM supplier)),
o AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY page, CASE item WHEN 1 THEN 2.5 ELSE item END) - 1 AS position FROM e)
SELECT s_suppkey::VARCHAR AS sample_id, position::INT AS position, CASE item WHEN 1 THEN 'image' ELSE 'text' END AS modality, CASE WHEN item <> 1 THEN t END AS text_content FROM o""")  # fmt: skip
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two pages with a head, a floating picture near the body, and a body; pictures come after their text."""
    files = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("file_name"), F.col("s_suppkey").cast("string").cast("binary").alias("content"))
    pages = media.page_images(files, lambda: lambda batch: [[x + b"/0", x + b"/1"] for x in batch])

    def read():
        item = lambda kind, t, y: {"kind": kind, "text": t, "y": y, "floating": kind == "picture"}
        return lambda batch: [[item("title", "head " + x.decode(), 1.0), item("picture", "pic " + x.decode(), 8.0), item("text", "body " + x.decode(), 9.0)] for x in batch]

    return media.page_rows(media.parsed_pages(pages, read)).select("sample_id", "position", "modality", "text_content")


# --- made rows and their scores


@query("designed_rows", "SELECT i AS id, 'x' AS kind, i * i AS square, upper('of x: ' || (i * i)) AS story FROM range(300) t(i)")
def designed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [{"name": "kind", "values": ["x"]}, {"name": "square", "expr": "id * id"}, {"name": "story", "model": "m", "prompt": "of {kind}: {square}"}]
    return media.designed_rows(spark, 300, columns, {"m": lambda: lambda batch: [t.upper() for t in batch]})


@query("translation_scores", "SELECT p_partkey, least(length(p_name), length(p_type)) / greatest(length(p_name), length(p_type))::DOUBLE AS quality FROM part WHERE least(length(p_name), length(p_type)) / greatest(length(p_name), length(p_type))::DOUBLE >= 0.5")
def translation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in metric that compares lengths."""
    df = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_type").alias("translated_text"))
    rate = lambda: lambda batch: [{"quality": min(len(x["text"]), len(x["translated_text"])) / max(len(x["text"]), len(x["translated_text"]))} for x in batch]
    return media.translation_scores(df, rate, least=0.5).select("p_partkey", "quality")


@query("blur_filter", "SELECT p_partkey FROM part WHERE p_size % 4 <> 0")
def blur_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkered pictures are sharp, even ones (of every fourth part) are not."""
    import numpy as np

    def decode(raw: bytes) -> np.ndarray:
        n = int(raw.decode())
        return np.full((8, 8), 128) if n % 4 == 0 else np.indices((8, 8)).sum(axis=0) % 2 * 255

    images = interleaved.align(read_table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sample_id"), F.lit(0).alias("position"), F.lit("image").alias("modality"), "p_partkey", F.col("p_size").cast("string").cast("binary").alias("binary_content")))
    return interleaved.score_filter(images, interleaved.blur_score(decode, F.col("binary_content")), least=100.0).select("p_partkey")
