"""Queries of semantic deduplication, segments, clips, interleaved rows, model output, translation and streams.

Inputs that the tables don't have, such as nested segments, are derived from
those they have, in the same way in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.core.graph import connected_components
from millrace.core.session import read_table
from millrace.functions import clean, code, edits
from millrace.operators import audio, interleaved, models, segments, semantic, synthetic, video
from millrace.sources import html
from millrace.streaming import ingest

from .base import query

# --- segments: turns of conversations laid out in time


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    df = read_table(spark, sf_dir, "conversations").withColumn("text", t).withColumn("start", (F.col("turn") * 10 + F.length("text") % 7).cast("double"))
    return df.withColumn("end", F.col("start") + F.length("text") % 23 + 1)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.struct("start", "end", F.col("role").alias("speaker"), "text", (F.length("text") % 3 * 8000).cast("int").alias("bandwidth"))
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))


_S = "s AS (SELECT conv_id, turn, role, txt, (turn * 10 + length(txt) % 7)::DOUBLE AS a, (turn * 10 + length(txt) % 7 + length(txt) % 23 + 1)::DOUBLE AS b FROM (SELECT *, coalesce(text, '') AS txt FROM conversations))"


@query("overlap_filter", f"""
WITH {_S}, f AS (SELECT * FROM s WHERE trim(txt) <> ''),
bad AS (SELECT DISTINCT x.conv_id, x.turn FROM f x JOIN f y ON x.conv_id = y.conv_id AND x.turn <> y.turn AND x.a < y.b AND y.a < x.b
  WHERE least(x.b, y.b) - greatest(x.a, y.a) >= 2 OR (x.a <= y.a AND x.b >= y.b) OR (y.a <= x.a AND y.b >= x.b)),
n AS (SELECT conv_id, count(*) AS k FROM bad GROUP BY conv_id)
SELECT s.conv_id, count(*) FILTER (WHERE trim(txt) = '') AS dropped_empty, coalesce(any_value(k), 0) AS dropped_overlap, count(*) FILTER (WHERE trim(txt) <> '') - coalesce(any_value(k), 0) AS kept
FROM s LEFT JOIN n USING (conv_id) GROUP BY s.conv_id""")  # fmt: skip
def overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = segments.drop_overlapping(_segments(spark, sf_dir), least=2.0)
    return df.select("conv_id", F.col("dropped_empty").cast("long"), F.col("dropped_overlap").cast("long"), F.size("segments").cast("long").alias("kept"))


@query("segment_gaps", f"""
WITH {_S}, g AS (SELECT conv_id, coalesce(lag(b) OVER w, 0) AS p, a AS q FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY a, b)
  UNION ALL SELECT conv_id, arg_max(b, (a, b)), 1000 FROM s GROUP BY conv_id)
SELECT conv_id, count(*) AS n, sum(q - p) AS seconds FROM g WHERE q > p GROUP BY conv_id""")  # fmt: skip
def segment_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _segments(spark, sf_dir).select("conv_id", F.explode(segments.gaps(F.col("segments"), F.lit(1000.0))).alias("g"))
    return df.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("g.end") - F.col("g.start")).alias("seconds"))


@query("merged_spans", f"""
WITH {_S}, m AS (SELECT *, max(b) OVER (PARTITION BY conv_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a - before > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM m)
SELECT conv_id, min(a) AS span_start, max(b) AS span_end FROM i GROUP BY conv_id, isle HAVING max(b) - min(a) >= 5""")  # fmt: skip
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("conv_id", F.explode(segments.merge(F.col("segments"), 2.0, 5.0)).alias("m")).select("conv_id", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"))


@query("snippet_plan", f"""
WITH RECURSIVE {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY a, b) AS i FROM s),
f AS (SELECT conv_id, i, a AS first, b AS last, 0 AS k, txt FROM r WHERE i = 1
  UNION ALL SELECT r.conv_id, r.i, CASE WHEN r.b - first <= 40 AND r.a - last <= 6 THEN first ELSE r.a END, r.b, CASE WHEN r.b - first <= 40 AND r.a - last <= 6 THEN k ELSE k + 1 END, r.txt
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1)
SELECT conv_id, min(first) AS span_start, arg_max(last, i) AS span_end, count(*) AS n FROM f GROUP BY conv_id, k
HAVING arg_max(last, i) - min(first) BETWEEN 3 AND 40 AND bool_or(trim(txt) <> '')""")  # fmt: skip
def snippet_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = segments.plan_snippets(_segments(spark, sf_dir), max_duration=40.0, min_duration=3.0, max_gap=6.0)
    return df.select("conv_id", F.explode("snippets").alias("x")).select("conv_id", F.col("x.start").alias("span_start"), F.col("x.end").alias("span_end"), F.size("x.segments").cast("long").alias("n"))


@query("split_points", f"""
WITH RECURSIVE {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY a, b) AS i FROM s),
f AS (SELECT conv_id, i, CASE WHEN b - 0 > 30 THEN 0::DOUBLE END AS cut, 0::DOUBLE AS first, b AS prev FROM r WHERE i = 1
  UNION ALL SELECT r.conv_id, r.i, CASE WHEN r.b - first > 30 THEN prev END, CASE WHEN r.b - first > 30 THEN prev ELSE first END, r.b FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1)
SELECT conv_id, cut::DOUBLE AS cut FROM f WHERE cut IS NOT NULL""")  # fmt: skip
def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("conv_id", F.explode(segments.split_points(F.col("segments"), 30.0)).alias("cut"))


@query("concat_offsets", f"""
WITH {_S}, l AS (SELECT conv_id, a, b, floor(b * 1000)::BIGINT - floor(a * 1000)::BIGINT AS n FROM s),
o AS (SELECT *, coalesce(sum(n + 500) OVER (PARTITION BY conv_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM l)
SELECT conv_id, floor(a * 1000)::BIGINT AS original_start_ms, off AS concat_start_ms, off + n AS concat_end_ms FROM o""")  # fmt: skip
def concat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _segments(spark, sf_dir).select("conv_id", F.explode(segments.concat_offsets(F.col("segments"))).alias("m"))
    return df.select("conv_id", "m.original_start_ms", "m.concat_start_ms", "m.concat_end_ms")


@query("training_windows")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _segments(spark, sf_dir).select("conv_id", F.lit(16000).alias("audio_sample_rate"), F.transform("segments", lambda s: s.withField("words", F.expr("cast(array() as array<struct<word:string,start:double,end:double>>)"))).alias("segments"))
    df = audio.training_windows(df, duration=30.0, tolerance=0.5)
    return audio.filter_windows(df, 50.0, 30.0).select("conv_id", F.size("windows").alias("n_windows"), F.size("kept_windows").alias("n_kept"), "kept_duration", "lost_window", "truncations")


@query("words_to_segments")
def words_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _segments(spark, sf_dir)
    words = F.flatten(F.transform("segments", lambda s: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("word"), (s["start"] + i * 2).alias("start"), (s["start"] + i * 2 + 2).alias("end")))))
    out = segments.words_to_segments(df.withColumn("alignment", words))
    return audio.module_segments(out, min_duration=2.0, max_duration=15.0).select("conv_id", F.size("aligned").alias("n_aligned"), F.size("prepared").alias("n_prepared"))


@query("even_windows", "SELECT conv_id, greatest(count(*) - 2, 0)::INT AS n_windows, least(count(*), 2)::INT AS lost_window FROM conversations GROUP BY conv_id")
def even_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of ten seconds by two speakers in turn: each but the last two begins a window of thirty."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    s = read_table(spark, sf_dir, "conversations").select("conv_id", at.alias("k"))
    seg = F.struct((F.col("k") * 10.0).alias("start"), (F.col("k") * 10.0 + 10).alias("end"), F.concat(F.lit("s"), (F.col("k") % 2).cast("string")).alias("speaker"), F.lit("t").alias("text"), F.lit(16000).alias("bandwidth"), F.expr("cast(array() as array<struct<word:string,start:double,end:double>>)").alias("words"))
    df = s.groupBy("conv_id").agg(F.array_sort(F.collect_list(seg), lambda x, y: F.when(x["start"] < y["start"], -1).otherwise(1)).alias("segments")).withColumn("audio_sample_rate", F.lit(16000))
    return audio.training_windows(df, duration=30.0, tolerance=0.0).select("conv_id", F.size("windows").alias("n_windows"), "lost_window")


@query("aligned_words", "SELECT conv_id, string_agg('w' || turn || ' x' || turn, '|' ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words in each of the segments of a conversation, given in one list."""
    t = F.col("turn").cast("string")
    word = lambda w, a: F.struct(F.concat(F.lit(w), t).alias("word"), (F.col("turn") * 10 + a).cast("double").alias("start"), (F.col("turn") * 10 + a + 2).cast("double").alias("end"))
    seg = F.struct((F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + 8).cast("double").alias("end"), F.lit("s").alias("speaker"))
    df = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(seg).alias("segments"), F.flatten(F.collect_list(F.array(word("w", 1), word("x", 5)))).alias("alignment"))
    out = segments.words_to_segments(df)
    return out.select("conv_id", F.array_join(F.transform(F.array_sort("aligned", lambda x, y: F.when(x["start"] < y["start"], -1).otherwise(1)), lambda x: x["text"]), "|").alias("texts"))


@query("counted_tokens", "SELECT doc_id, len(string_split(text, ' '))::INT AS token_count, least(len(string_split(text, ' ')), 20)::INT AS kept FROM documents WHERE len(string_split(text, ' ')) BETWEEN 10 AND 5000")
def counted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts by a stand-in tokenizer that splits at spaces, and token lists cut at twenty."""
    split = lambda: lambda batch: [[len(w) for w in t.split(" ")] for t in batch]
    df = models.token_count_filter(read_table(spark, sf_dir, "documents").select("doc_id", "text"), split, 10, 5000)
    return models.tokenize(df, split, max_tokens=20).select("doc_id", "token_count", F.size("attention_mask").alias("kept"))


_HALL = ["Thank you for watching", "so", "yes"]


@query("hallucination_flags", """
WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT *, list_sort(list_transform(w, lambda x: length(x))) AS n, list_contains(['de'], 'en') AS comp FROM w)
SELECT doc_id, len(list_distinct(w)) / len(w)::DOUBLE <= 0.4 AS repeated, n[len(n)] >= 25 OR coalesce(n[len(n) - 1] > 0 AND (n[len(n)] - n[len(n) - 1]) / n[len(n) - 1]::DOUBLE >= 3, false) AS long_word,
  length(array_to_string(w, '')) / 60.0 > 40 AS fast FROM l WHERE len(w) > 0""")  # fmt: skip
def hallucination_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "documents").select("doc_id", audio.hallucination(F.col("text"), F.lit(60.0), F.lit("en"), _HALL).alias("why")).where("why IS NOT NULL")
    has = lambda x: F.array_contains("why", x)
    return df.select("doc_id", has("repeated_ngrams").alias("repeated"), has("long_word").alias("long_word"), has("high_char_rate").alias("fast"))


@query("repeated_tokens", """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS i FROM w WHERE len(w) >= 10)),
c AS (SELECT doc_id, max(k) AS k FROM (SELECT doc_id, g, count(*) AS k FROM g GROUP BY doc_id, g) GROUP BY doc_id)
SELECT w.doc_id, coalesce(k, 0) > 3 AS repeats FROM w LEFT JOIN c USING (doc_id)""")  # fmt: skip
def repeated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", audio.repeats_ngram(F.col("text"), 10, 3).alias("repeats"))


@query("histogram_30s", """
WITH c AS (SELECT floor(value / 30)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT b AS bin, (b * 30)::DOUBLE AS start, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT greatest(max(bin), 0) + 1 FROM c))) AS b) LEFT JOIN c ON b = bin""")  # fmt: skip
def histogram_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.histogram(read_table(spark, sf_dir, "events").where("value >= 0"), "value", 30.0)


@query("snippet_ids", f"WITH {_S} SELECT conv_id, turn, 'conv_' || conv_id || '_' || (a * 1000)::BIGINT || '_' || (b * 1000)::BIGINT AS id FROM s")
def snippet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", audio.snippet_id(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")), F.col("start"), F.col("end")).alias("id"))


@query("preserve_by_value", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'")
def preserve_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.compare(audio.compare(read_table(spark, sf_dir, "orders"), "o_totalprice", 100000, "ge"), "o_orderstatus", "F", "ne").select("o_orderkey")


@query("score_thresholds", "SELECT event_id FROM events WHERE value >= 10 AND user_id >= 5")
def score_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.keep_scores(read_table(spark, sf_dir, "events"), {"value": 10, "user_id": 5, "ts": None}).select("event_id")


@query("char_error_rate", "SELECT doc_id, round(levenshtein(regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g'), regexp_replace(lower(text[3:]), '[^\\x00-\\x7F]', '?', 'g')) / length(text)::DOUBLE, 4) AS cer FROM documents WHERE length(text) > 0")
def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts against themselves from the third character on, in lower case."""
    df = read_table(spark, sf_dir, "documents").where(F.length("text") > 0)
    ascii_ = lambda c: F.regexp_replace(c, "[^\\x00-\\x7F]", "?")  # noqa: E731  SQL's distance is of bytes
    return df.select("doc_id", edits.char_errors(ascii_(F.col("text")), ascii_(F.lower(F.substr("text", F.lit(3)))))["rate"].alias("cer"))


@query("word_error_rate")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edits.word_errors(edits.clean_transcript(F.col("text")), edits.clean_transcript(F.substr("text", F.lit(10))))
    return read_table(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", "e.*")


# --- clips


@query("fixed_stride_clips", """
WITH d AS (SELECT p_partkey, p_size, p_retailprice / 25.0 AS d FROM part),
c AS (SELECT p_partkey, d, unnest(range(0, floor(d / 5)::BIGINT + 1)) * 5.0 AS a FROM d)
SELECT p_partkey, a::DOUBLE AS span_start, least(a + 10, d)::DOUBLE AS span_end FROM c WHERE a < d AND least(a + 10, d) - a >= 2""")  # fmt: skip
def fixed_stride_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("file"), F.col("p_retailprice").alias("num_frames"), F.lit(25.0).alias("framerate"))
    return video.fixed_stride(df, 10.0, 5.0, 2.0).select("p_partkey", "span_start", "span_end")


@query("frame_windows", """
WITH f AS (SELECT p_partkey, (p_size * 17)::BIGINT AS n FROM part),
k AS (SELECT *, n // 128 + (n % 128 >= 64)::INT AS c FROM f),
x AS (SELECT p_partkey, n, c, unnest(range(0, greatest(c, 1))) AS i FROM k WHERE n >= 4)
SELECT p_partkey, CASE WHEN n <= 128 THEN 0 ELSE i * 128 END::INT AS window_start, CASE WHEN n <= 128 OR i = c - 1 THEN n - 1 ELSE (i + 1) * 128 - 1 END::INT AS window_end FROM x WHERE n > 128 OR i = 0""")  # fmt: skip
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part").select("p_partkey", F.explode(video.frame_windows(F.col("p_size") * 17)).alias("w"))
    return df.select("p_partkey", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


@query("scenes", """
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
f AS (SELECT conv_id, k * 10 + i AS idx, ((i + turn) % 7 = 3)::INT AS cut FROM r, (SELECT unnest(range(10)) AS i)),
n AS (SELECT conv_id, count(*) AS n, sum(cut) FILTER (WHERE idx > 0) AS cuts FROM f GROUP BY conv_id),
z AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY idx) AS g FROM f),
spans AS (SELECT conv_id, min(idx) AS a, max(idx) + 1 AS b FROM z WHERE cut = 0 GROUP BY conv_id, g),
s AS (SELECT conv_id, a, CASE WHEN b < n THEN b ELSE n - 1 END AS b FROM spans JOIN n USING (conv_id) WHERE cuts > 0 UNION ALL SELECT conv_id, 0, n FROM n WHERE cuts = 0),
p AS (SELECT conv_id, a + i * 4 AS a, least(a + (i + 1) * 4, b) AS b FROM (SELECT conv_id, a, b, unnest(range(0, greatest(ceil((b - a) / 4.0)::INT, 1))) AS i FROM s))
SELECT conv_id, a::INT AS start, b::INT AS "end" FROM p WHERE b - a >= 2""")  # fmt: skip
def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _turns(spark, sf_dir).groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((i + t) % 7 == 3).cast("int")))).alias("f"))
    return flags.select("conv_id", F.explode(video.fit_scenes(video.scenes(F.col("f")), 2, 4)).alias("s")).select("conv_id", "s.*")


@query("motion_filter", "SELECT event_id FROM events WHERE coalesce(value / 1000, -1) >= 0.00098 AND coalesce(value / 1000000, -1) >= 0.000001")
def motion_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "events").select("event_id", (F.col("value") / 1000).alias("motion_mean"), (F.col("value") / 1000000).alias("motion_patch_min"))
    return video.motion_filter(df).select("event_id")


@query("frame_score_filter", "SELECT user_id, min(value) AS score FROM events GROUP BY user_id HAVING min(value) >= 0.5")
def frame_score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("scores"))
    return video.frame_score_filter(df, "scores").select("user_id", "score")


# --- interleaved rows


def _interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "metadata").when(F.col("role") == "assistant", "image").otherwise("text")
    df = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("sample_id"), F.when(kind == "metadata", -1).otherwise(F.col("turn") * 2).cast("int").alias("position"), kind.alias("modality"), F.col("text").alias("text_content"))
    return interleaved.align(df)


_I = "i AS (SELECT conv_id::VARCHAR AS sample_id, CASE WHEN role = 'system' THEN -1 ELSE turn * 2 END AS position, CASE role WHEN 'system' THEN 'metadata' WHEN 'assistant' THEN 'image' ELSE 'text' END AS modality, text FROM conversations)"


@query("renumbered_positions", f"""
WITH {_I}, n AS (SELECT *, count(*) FILTER (WHERE modality <> 'metadata') OVER (PARTITION BY sample_id) AS c, row_number() OVER (PARTITION BY sample_id, modality = 'metadata' ORDER BY position) - 1 AS k FROM i)
SELECT sample_id, CASE WHEN modality = 'metadata' THEN -1 ELSE k END::INT AS position, modality FROM n WHERE c > 0""")  # fmt: skip
def renumbered_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved.renumber(interleaved.valid(_interleaved(spark, sf_dir))).select("sample_id", "position", "modality")


@query("image_text_ratio", f"""
WITH {_I}, r AS (SELECT sample_id, count(*) FILTER (WHERE modality = 'image') / greatest(sum(CASE WHEN modality = 'text' THEN len(list_filter(string_split_regex(text, '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda w: w <> '')) ELSE 0 END), 1)::DOUBLE AS r,
  count(*) FILTER (WHERE modality <> 'metadata') AS n FROM i GROUP BY sample_id)
SELECT sample_id, n FROM r WHERE r BETWEEN 0.02 AND 0.1 AND n > 0""")  # fmt: skip
def image_text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = interleaved.image_text_ratio_filter(_interleaved(spark, sf_dir), 0.02, 0.1)
    return kept.where("modality <> 'metadata'").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@query("nearest_anchor", """
WITH t AS (SELECT conv_id, turn, role = 'assistant' AS floating, (length(coalesce(text, '')) % 97)::DOUBLE AS y FROM conversations),
m AS (SELECT f.conv_id, f.turn, min((abs(f.y - a.y), a.turn)) AS m FROM t f JOIN t a ON f.conv_id = a.conv_id AND f.floating AND NOT a.floating GROUP BY f.conv_id, f.turn),
j AS (SELECT t.*, CASE WHEN floating THEN coalesce(m.m[2], -1) ELSE t.turn END AS anchor FROM t LEFT JOIN m ON t.conv_id = m.conv_id AND t.turn = m.turn)
SELECT conv_id, turn AS item, (row_number() OVER (PARTITION BY conv_id ORDER BY anchor, floating, CASE WHEN floating THEN y END, turn) - 1)::INT AS place FROM j""")  # fmt: skip
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").alias("page"), F.col("turn").alias("item"), (F.col("role") == "assistant").alias("floating"), (F.length(F.coalesce("text", F.lit(""))) % 97).cast("double").alias("y"))
    return interleaved.place_floaters(t).select("conv_id", "item", "place")


# --- semantic deduplication


@query("semantic_pairwise", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM v),
p AS (SELECT b.vec_id, b.r, a.vec_id AS m, a.r AS mr, list_inner_product(a.e, b.e) AS s FROM u b LEFT JOIN u a ON a.label = b.label AND a.r < b.r)
SELECT vec_id AS id, round(CASE WHEN any_value(r) = 0 THEN 0 ELSE greatest(max(s), 0) END, 6) AS score FROM p GROUP BY vec_id""")  # fmt: skip
def semantic_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("label").alias("centroid"), semantic.normalized(F.col("embedding")).alias("embedding"))
    ranked = semantic.rank(e, "vec_id", by=[("vec_id", True)])
    return semantic.pairwise(ranked, "vec_id").select("id", F.round("score", 6).alias("score"))


@query("semantic_dedup")
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.semantic_dedup(read_table(spark, sf_dir, "embeddings"), k=10, eps=0.05, id_col="vec_id", max_iter=20).select("vec_id")


@query("connected_components", "SELECT p_partkey AS node, (p_partkey // 50) * 50 AS component FROM part UNION SELECT (p_partkey // 50) * 50, (p_partkey // 50) * 50 FROM part WHERE p_partkey % 50 <> 0")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    # chains of fifty neighbours, and a loop where a chain has one node
    p = F.col("p_partkey").cast("long")
    chain = read_table(spark, sf_dir, "part").where(p % 50 != 0).select(p.alias("src"), (p - 1).alias("dst"))
    alone = read_table(spark, sf_dir, "part").select(p.alias("node")).where(p % 50 == 0)
    found = connected_components(chain)
    return found.unionByName(alone.join(found.hint("merge"), "node", "left_anti").withColumn("component", F.col("node")))


# --- model output and translation


@query("edu_scores", "SELECT event_id, greatest(least(value / 20 - 1, 5), 0) AS float_score, round_even(greatest(least(value / 20 - 1, 5), 0), 0)::INT AS int_score, CASE WHEN value / 20 - 1 >= 2.5 THEN 'high_quality' ELSE 'low_quality' END AS label FROM events WHERE value IS NOT NULL")
def edu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", (F.col("value") / 20 - 1).alias("raw"))
    return models.edu_scores(df, F.col("raw"), "float_score", "int_score", "label").drop("raw")


@query("safety_labels", "SELECT doc_id, CASE WHEN toxic = 0 THEN 'safe' WHEN quality = 1 THEN 'Threat' ELSE 'unknown' END AS label FROM labels")
def safety_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("toxic") == 0, "safe").when(F.col("quality") == 1, "unsafe\nThreat").otherwise("unsafe\nno such thing")
    return read_table(spark, sf_dir, "labels").select("doc_id", models.safety_label(answer, ["Threat", "Violence"]).alias("label"))


@query("classified_domains", "SELECT doc_id, CASE WHEN length(text) % 3 = 0 THEN 'a' ELSE 'b' END AS domain FROM documents WHERE text IS NOT NULL AND length(text) % 3 < 2")
def classified_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model that goes by length, to run the operator around it."""
    def make():
        return lambda batch: [[float(len(t) % 3 == k) for k in range(3)] for t in batch]

    return models.classify(read_table(spark, sf_dir, "documents").select("doc_id", "text"), make, ["a", "b", "c"], "domain", keep=["a", "b"]).select("doc_id", "domain")


@query("quality_model")
def quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    return models.quality_model(docs, read_table(spark, sf_dir, "labels")).transform(docs).select("doc_id", F.col("prediction").cast("int").alias("quality"))


@query("token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return models.token_count_filter(read_table(spark, sf_dir, "documents").select("doc_id", "text"), models.tokenizer(public_tokenizers.path("piece_bpe_32k.model")), 10, 100_000).select("doc_id", "token_count")


@query("token_chunks")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return models.token_chunks(read_table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"), models.tokenizer(public_tokenizers.path("piece_bpe_32k.model")), 200, "\n")


@query("knowledge_lists", """
WITH l AS (SELECT doc_id, string_split('- ' || coalesce(text, ''), chr(10)) AS l FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(l, lambda s: CASE WHEN starts_with(s, '- ') OR starts_with(s, '  ') THEN
  regexp_replace(regexp_replace(s[3:], '^[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ''), '[\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '')
  ELSE s END), chr(10))) AS h FROM l""")  # fmt: skip
def knowledge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = synthetic.knowledge_list(F.concat(F.lit("- "), F.coalesce("text", F.lit(""))))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("h"))


@query("translation_segments", "SELECT doc_id, (i - 1)::INT AS segment_id, md5(l[i]) AS h, regexp_matches(l[i], '\\p{L}') AND NOT (starts_with(trim(l[i]), '<') AND ends_with(trim(l[i]), '>')) AS translate FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))")
def translation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = synthetic.segment(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return s.select("doc_id", "segment_id", F.md5(F.col("segment").cast("binary")).alias("h"), "translate")


@query("translation_round_trip", "SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents")
def translation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, a translation that changes nothing, and the text again."""
    s = synthetic.segment(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", mode="fine").drop("text")
    out = synthetic.reassemble(synthetic.translate(s, lambda: lambda batch: batch), "doc_id")
    return out.select("doc_id", F.md5(F.col("translated_text").cast("binary")).alias("h"))


@query("faith_average", "SELECT doc_id, CASE WHEN (quality <> 0)::INT + (toxic <> 0)::INT = 0 THEN 0.0 ELSE (quality * 4 + toxic * 3) / ((quality <> 0)::INT + (toxic <> 0)::INT)::DOUBLE END AS faith_avg FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def faith_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", synthetic.faith_average([F.col("quality") * 4, F.col("toxic") * 3]).alias("faith_avg"))


@query("nested_fields", "SELECT conv_id, string_agg(coalesce(text, ''), '|' ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.struct(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("content")))).alias("messages")).alias("r"))
    return df.select("conv_id", F.array_join(synthetic.nested(F.col("r"), "messages.*.content"), "|").alias("texts"))


# --- source code, broken text, pages


@query("extension_rules", "SELECT doc_id, CASE WHEN list_max(list_transform(string_split(text, chr(10)), lambda s: length(s))) > 300 OR (length(text) + 1) / len(string_split(text, chr(10)))::DOUBLE - 1 > 100 OR len(regexp_extract_all(text, '[a-zA-Z0-9]')) < 0.25 * length(text) THEN 0 ELSE 1 END AS keep FROM documents WHERE text IS NOT NULL")
def extension_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("python", "py", True, 300, 0.25, None)], "language string, extension string, include boolean, longest_line int, alnum_share double, alpha_share double")
    df = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.lit("py").alias("extension"))
    return code.extension_rules(df, rules, "Python").select("doc_id", "keep")


@query("python_comments")
def python_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", code.python_comment_share(F.col("text")).alias("score"))


@query("general_comments")
def general_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", code.comment_share(F.col("text"), "text/x-python").alias("score"))


@query("html_visible")
def html_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", code.html_visible_share(F.col("html")).alias("score"))


@query("fertility")
def fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_table(spark, sf_dir, "documents").select("doc_id", code.fertility(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("score"))


@query("unicode_repair")
def unicode_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(clean.repair_unicode(F.col("text")).cast("binary")).alias("h"))


for _name in html.ALGORITHMS:

    @query(f"pages_{_name}")
    def _pages(spark: SparkSession, sf_dir: str, algorithm: str = _name) -> DataFrame:
        return html.extract_text(read_table(spark, sf_dir, "pages"), algorithm=algorithm).select("page_id", "language", "text")


# --- windows over events


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(read_table(spark, sf_dir, "events"))


@query("sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM i GROUP BY user_id, s""")  # fmt: skip
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(read_table(spark, sf_dir, "events"))
