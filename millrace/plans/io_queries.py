"""Queries of readers, writers, archives, downloads, pipelines from specs, resumption, streams and model wrappers.

Most are round trips: a table is written with the library's writer into the
shared folder, read back with its reader, and must be what it was. Models are
stand-ins whose answers SQL can state, run by the operators around them.
"""

from __future__ import annotations

import gzip
import json
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.scratch import materialize, scratch_root
from millrace.core.session import read_table, spread
from millrace.functions import text
from millrace.operators import audio, interleaved, models, segments, synthetic
from millrace.sinks import writers
from millrace.sources import archives, download, readers
from millrace.streaming import ingest

from . import pipeline, record_queries, sql, text_queries  # noqa: F401  queries whose SQL is shared
from .base import ORACLE_SQL, query


def _place(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


def _mounted(path: str) -> str:
    return path.removeprefix("file://")


# --- documents from and to files


@query("jsonl_round_trip", "SELECT doc_id, md5(text) AS h, lang FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "jsonl")
    writers.write_documents(read_table(spark, sf_dir, "documents"), at, "json")
    back = readers.read_documents(spark, at, "json", schema="doc_id long, text string, lang string, source string, n_chars long", fields=["doc_id", "text", "lang", "absent"])
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), "lang")


@query("parquet_round_trip", "SELECT doc_id, md5(text) AS h FROM documents WHERE lang = 'en'")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "parquet")
    writers.write_documents(read_table(spark, sf_dir, "documents"), at, fields=["doc_id", "text", "lang"], partition_by=["lang"], max_records=5000)
    back = readers.read_documents(spark, f"{at}/lang=en", fields=["doc_id", "text"], block_bytes=64 << 20)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("file_groups", "SELECT n_name AS file, (n_nationkey // 4)::INT AS file_group FROM nation")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file list (25 names here) in groups of four; such lists are short enough for the driver."""
    names = [(r.n_name, 1) for r in read_table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    groups = pipeline.file_groups(names, per_group=4)
    return spark.createDataFrame([(f, k) for k, g in enumerate(groups) for f in g], "file string, file_group int")


@query("listed_files", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, names = _place(spark, "listed"), _place(spark, "listing")
    read_table(spark, sf_dir, "nation").write.partitionBy("n_regionkey").parquet(at)
    spark.createDataFrame([(json.dumps(["n_regionkey=1", "n_regionkey=3"]),)], "value string").coalesce(1).write.text(names)
    return readers.read_listed(spark, names, at).select("n_nationkey", "n_name")


@query("split_files", "SELECT doc_id, length(text) AS n FROM documents")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, parts = _place(spark, "whole"), _place(spark, "parts")
    spread(read_table(spark, sf_dir, "documents"), 100_000).write.parquet(whole)  # large files of some 300 MB of text
    writers.split_by_size(spark, whole, parts, 4)
    return spark.read.parquet(parts).select("doc_id", F.length("text").cast("long").alias("n"))


@query("merged_lines", "SELECT doc_id, md5(text) AS h, (SELECT count(*) FROM documents) AS lines FROM documents")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, target = _place(spark, "shards"), _place(spark, "merged") + ".jsonl"
    docs = read_table(spark, sf_dir, "documents")
    writers.write_documents(docs.repartition(max(5, docs.count() // 50_000)), shards, "json", fields=["doc_id", "text"])
    n = writers.merge_lines(spark, shards, target)
    return spark.read.schema("doc_id long, text string").json(target).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.lit(n).cast("long").alias("lines"))


def _by_spaces():
    return lambda batch: [[len(w) for w in t.split(" ")] for t in batch]


@query("token_stream", "SELECT count(*) AS documents, sum(len(string_split(text, ' ')) + 1)::BIGINT AS tokens, 'uint16' AS kind FROM documents WHERE text IS NOT NULL")
def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a partition each, merged; counts come from the merged index."""
    at = _mounted(_place(spark, "tokens"))
    writers.write_tokens(read_table(spark, sf_dir, "documents").select(F.regexp_replace("text", "[^ ]{200,}", "x").alias("text")), _by_spaces, at, 60_000, end=0).count()
    writers.merge_token_files(at, f"{at}-merged/all")
    with open(f"{at}-merged/all.idx", "rb") as f:
        kind, lengths = writers.read_index(f.read())
    return spark.createDataFrame([(len(lengths), int(lengths.sum()), kind)], "documents long, tokens long, kind string")


@query("manifest_round_trip", "SELECT '/audio/' || p_partkey || '.wav' AS audio_filepath, p_retailprice AS duration, (SELECT count(*) FROM part) AS n FROM part")
def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, totals = _place(spark, "manifest"), _place(spark, "totals")
    rows = read_table(spark, sf_dir, "part").select(F.concat(F.lit("old/"), F.col("p_partkey").cast("string"), F.lit(".wav")).alias("audio_filepath"), F.col("p_retailprice").alias("duration"))
    writers.finish_manifest(rows, manifest, totals)
    n = spark.read.json(totals).select(F.col("rows").cast("long").alias("n"))
    return readers.read_manifest(spark, manifest, "/audio", schema="audio_filepath string, duration double").crossJoin(F.broadcast(n))  # one row of totals


@query("transcripts", "SELECT '/clips/' || s_suppkey || '.wav' AS audio_filepath, s_name AS text FROM supplier")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "tsv")
    s = read_table(spark, sf_dir, "supplier")
    s.select(F.col("s_suppkey").cast("string"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".wav")), F.upper("s_name"), "s_name").write.options(sep="\t", quote="").csv(at)
    return readers.read_transcripts(spark, at, "/clips")


@query("pdf_manifest", "SELECT file_name, 'http://x/' || n_nationkey AS url FROM (SELECT n_nationkey, unnest([n_name || '.pdf', n_name || '-2.pdf']) AS file_name FROM nation)")
def pdf_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, n = _place(spark, "pdf"), F.col("n_name")
    nation = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("http://x/"), F.col("n_nationkey").cast("string")).alias("url"), F.array(F.concat(n, F.lit(".pdf")), F.concat(n, F.lit("-2.pdf"))).alias("cc_pdf_file_names"))
    nation.write.json(at)
    return readers.read_pdf_manifest(spark, at)


# --- interleaved rows and tars


_ROWS = "SELECT conv_id::VARCHAR AS sample_id, (turn * 2)::INT AS position, CASE role WHEN 'assistant' THEN 'image' ELSE 'text' END AS modality, text FROM conversations WHERE text IS NOT NULL AND role <> 'system'"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as texts, of assistants as images (their UTF-8 bytes)."""
    image = F.col("role") == "assistant"
    df = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role <> 'system'")
    return interleaved.align(df.select(
        F.col("conv_id").cast("string").alias("sample_id"), (F.col("turn") * 2).cast("int").alias("position"), F.when(image, "image").otherwise("text").alias("modality"),
        F.when(image, "image/png").otherwise("text/plain").alias("content_type"), F.when(~image, F.col("text")).alias("text_content"), F.when(image, F.col("text").cast("binary")).alias("binary_content"),
    ))


@query("interleaved_round_trip", f"SELECT sample_id, position, modality, md5(text) AS h FROM ({_ROWS})")
def interleaved_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "interleaved")
    writers.write_interleaved(_samples(spark, sf_dir), at)
    return readers.read_interleaved(spark, at).select("sample_id", "position", "modality", F.md5(F.coalesce("binary_content", F.col("text_content").cast("binary"))).alias("h"))


@query("tar_round_trip", f"SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY position) - 1)::INT AS position, modality, md5(text) AS h FROM ({_ROWS})")
def tar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as tars and back: a list of texts and images by position, images read by reference from the tars."""
    at = _place(spark, "tars")
    rows = _samples(spark, sf_dir)
    tars = max(2, rows.count() // 20_000)  # of some 20 MB each, however many rows there are
    members = writers.sample_members(rows).repartition(tars, F.regexp_extract("name", "^[0-9]+", 0))
    writers.write_tars(members.sortWithinPartitions("name"), _mounted(at), per_tar=100_000).count()
    back = archives.samples(spark, at).where("position >= 0")
    return archives.materialize_content(back, at).select("sample_id", "position", "modality", F.md5(F.coalesce("binary_content", F.col("text_content").cast("binary"))).alias("h"))


@query("media_list", f"WITH r AS ({_ROWS}) SELECT count(*) FILTER (WHERE modality = 'image') + count(DISTINCT sample_id) AS members, 1 AS tars FROM r")
def media_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "media")
    made = materialize(writers.write_tars(writers.sample_members(_samples(spark, sf_dir)).coalesce(1), _mounted(at), per_tar=10_000_000), "media-made")
    found = readers.list_media(spark, at, "*.tar").select(F.element_at(F.split("path", "/"), -1).alias("tar"))
    return found.join(made.select(F.element_at(F.split("tar", "/"), -1).alias("tar"), "members"), "tar").agg(F.sum("members").alias("members"), F.count(F.lit(1)).cast("int").alias("tars"))


@query("reconciled_schema", "SELECT n_nationkey::VARCHAR AS sample_id, n_regionkey AS position, 'text' AS modality, NULL::VARCHAR AS source_ref, n_name AS extra FROM nation")
def reconciled_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("extra"), F.lit("text").alias("modality"), F.col("n_regionkey").cast("long").alias("position"), F.col("n_nationkey").alias("sample_id"))
    return interleaved.align(df).select("sample_id", "position", "modality", "source_ref", "extra")


def _png(w, h):
    """The first bytes of a PNG of a size: what its dimensions are read from."""
    return F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(h), 8, "0"), F.lit("08020000000000000000")))


@query("aspect_ratio", "SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY p_partkey) - 1)::INT AS position, p_partkey AS k FROM (SELECT (p_partkey % 100)::VARCHAR AS sample_id, p_partkey, (p_size * 7) / 100.0 AS r FROM part) WHERE r >= 1.0 AND r <= 2.0")
def aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    images = read_table(spark, sf_dir, "part").select((k % 100).cast("string").alias("sample_id"), k.cast("int").alias("position"), F.lit("image").alias("modality"), _png((F.col("p_size") * 7).cast("long"), F.lit(100).cast("long")).alias("binary_content"), k.alias("k"))
    return interleaved.aspect_ratio_filter(interleaved.align(images)).select("sample_id", "position", "k")


@query("image_scores", "SELECT p_partkey FROM part WHERE p_retailprice / 1000 >= 0.3 AND p_size / 50.0 < 0.6")
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by two injected scores, one at least and one at most, as for blur and codes."""
    k = F.col("p_partkey")
    images = interleaved.align(read_table(spark, sf_dir, "part").select(k.cast("string").alias("sample_id"), F.lit(0).alias("position"), F.lit("image").alias("modality"), k.alias("p_partkey"), (F.col("p_retailprice") / 1000).alias("sharp"), (F.col("p_size") / 50.0).alias("codes")))
    kept = interleaved.score_filter(interleaved.score_filter(images, F.col("sharp"), least=0.3), F.col("codes"), below=0.6)
    return kept.select("p_partkey")


@query("image_text_similarity", """
WITH v AS (SELECT vec_id, vec_id // 10 AS s, vec_id % 10 AS p, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
b AS (SELECT i.vec_id FROM v i JOIN v t ON i.s = t.s AND i.p >= 5 AND t.p < 5 GROUP BY i.vec_id HAVING max(list_inner_product(i.e, t.e)) >= 0.25)
SELECT vec_id FROM v WHERE p < 5 UNION ALL SELECT vec_id FROM b""")  # fmt: skip
def image_text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    rows = interleaved.align(read_table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.expr("vec_id div 10").cast("string").alias("sample_id"), (v % 10).cast("int").alias("position"), F.when(v % 10 >= 5, "image").otherwise("text").alias("modality"), v, "embedding"))
    return interleaved.image_text_similarity_filter(rows, "embedding", 0.25).select("vec_id")


# --- web archives, encyclopedia dumps, papers, downloads


def _warc_record(page):
    """A response record as one string of ASCII and UTF-8: header, HTTP header, body."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.coalesce("html", F.lit("")))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Record-ID: <urn:uuid:"), page.cast("string"), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


@query("warc_pages", "SELECT page_id::VARCHAR AS warc_id, url, md5(coalesce(html, '')) AS h FROM pages WHERE url IS NOT NULL")
def warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "warc")
    read_table(spark, sf_dir, "pages").where("url IS NOT NULL").select(_warc_record(F.col("page_id"))).write.option("lineSep", "\r\n").text(at)
    return archives.warc(spark, at).select("warc_id", "url", F.md5("content").alias("h"))


@query("warc_ranges", "SELECT page_id, md5(coalesce(html, '')) AS h FROM pages WHERE url IS NOT NULL")
def warc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by file, offset and length, as an index would list them; archives of some thousand pages, as crawls have."""
    at = _place(spark, "ranges")
    pages = read_table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", _warc_record(F.col("page_id")).alias("value"))
    spread(pages.select("value")).write.option("lineSep", "\n").text(at)
    index = archives.records(archives.files(spark, at, "part-*"), _offsets, "warc_filename string, warc_record_offset long, warc_record_length long, page_id long")
    return archives.warc_ranges(index, at).select("page_id", F.md5("binary_content").alias("h"))


def _offsets(path: str, raw: bytes):
    """Where the records of an uncompressed archive stand."""
    at = 0
    while (at := raw.find(b"WARC/1.0\r\n", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at) + 4
        head = raw[at:end].decode()
        n = int(head.split("Content-Length: ")[1].split("\r\n")[0])
        yield {"warc_filename": "crawl/" + path.rsplit("/", 1)[1], "warc_record_offset": at, "warc_record_length": end - at + n, "page_id": int(head.split("<urn:uuid:")[1].split(">")[0])}
        at = end + n


@query("wiki_articles", "SELECT p_name AS title, p_partkey::VARCHAR AS id, 'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') AS url, p_type || ' of ' || p_brand || ' (' || p_name || ')' AS text FROM part WHERE p_partkey % 5 <> 0")
def wiki_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump of made articles, every fifth of another name space, with templates, nested links and comments to drop."""
    at, p = _place(spark, "wiki"), read_table(spark, sf_dir, "part")
    markup = F.concat(F.lit("{{box|{{inner|x}}}}<!-- gone -->'''"), F.col("p_type"), F.lit("''' of [[x:y|"), F.col("p_brand"), F.lit("]] ("), F.lit("[["), F.col("p_name"), F.lit("]])[[Datei:z.png|thumb|[[w]]]]\n{|\n| table\n|}"))
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    page = tag("page", F.concat(tag("title", escape(F.col("p_name"))), tag("ns", F.when(F.col("p_partkey") % 5 == 0, "14").otherwise("0")), tag("id", F.col("p_partkey").cast("string")), tag("revision", tag("text", escape(markup)))))

    def document(batches):
        edge = lambda t: pa.RecordBatch.from_pydict({"value": [t]})
        yield edge("<mediawiki>")
        yield from batches
        yield edge("</mediawiki>")

    spread(p, 50_000).select(page.alias("value")).mapInArrow(document, "value string").write.text(at)  # documents of bounded size, as large dumps are cut
    return archives.wiki_pages(spark, at).select("title", "id", "url", "text")


@query("tex_papers", "SELECT p_partkey::VARCHAR AS id, '\\section{' || p_name || '}' || chr(10) || 'We study ' || p_type || '{x} and ' || p_brand || ' at 5\\%.' || chr(10) AS text FROM part WHERE p_partkey % 3 <> 0")
def tex_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as gzipped files in tars: commands to expand, comments, a bibliography; every third has no section."""
    @F.pandas_udf("binary")
    def packed(t: pd.Series) -> pd.Series:
        return t.map(lambda x: gzip.compress(x.encode(), mtime=0))

    at, section = _place(spark, "tex"), F.when(F.col("p_partkey") % 3 == 0, "\\title").otherwise("\\section")
    tex = F.concat(
        F.lit("\\newcommand{\\kind}{"), F.col("p_type"), F.lit("{x}}\n\\def\\maker{"), F.col("p_brand"), F.lit("}\npreamble\n"), section, F.lit("{"), F.col("p_name"),
        F.lit("}\n% a comment\nWe study \\kind and \\maker at 5\\%.% more\n\\bibliography{refs}\nrest"),
    )
    members = spread(read_table(spark, sf_dir, "part")).select(F.concat(F.col("p_partkey").cast("string"), F.lit(".gz")).alias("name"), packed(tex).alias("content"))
    writers.write_tars(members, _mounted(at), per_tar=500).count()
    return archives.papers(spark, at).select("id", "text")


@query("downloads", "SELECT 'http://host/' || s_suppkey AS url, CASE WHEN s_suppkey % 7 <> 0 THEN length('body of ' || s_suppkey) END AS bytes, s_suppkey % 7 = 0 AS failed FROM supplier")
def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from a stand-in host that lacks every seventh; the second run finds what the first has left."""
    at = _mounted(_place(spark, "downloads"))
    urls = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("http://host/"), F.col("s_suppkey").cast("string")).alias("url"))

    def fetch(url: str) -> bytes:
        n = url.rsplit("/", 1)[1]
        if int(n) % 7 == 0:
            raise OSError("no such file")
        return f"body of {n}".encode()

    run = lambda: materialize(download.download(urls, at, fetch, retries=2, wait=0.0, per_task=50), "downloaded")
    first, again = run(), run()
    good, bad = download.failed(again)
    done = good.join(first.select("url", F.col("path").alias("before")), "url").where("path = before").select("url", "bytes", F.lit(False).alias("failed"))
    return done.unionByName(bad.select("url", F.lit(None).cast("long").alias("bytes"), F.lit(True).alias("failed")))


@query("dump_addresses", """
SELECT 'crawl' AS kind, 'https://data.commoncrawl.org/crawl-data/CC-MAIN-2024-' || w || '/' || n_nationkey || '.warc.gz' AS url FROM nation, (SELECT unnest(['18', '22']) AS w)
UNION ALL SELECT 'wiki', 'https://dumps.wikimedia.org/dewiki/20240601/dewiki-' || n_nationkey || '.xml.bz2' FROM nation
UNION ALL SELECT 'papers', 'src/arXiv_' || n_nationkey || '.tar' FROM nation""")  # fmt: skip
def dump_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses from a stand-in network's listings: crawls of some weeks, the newest finished dump, a bucket's tars."""
    keys = [r.n_nationkey for r in read_table(spark, sf_dir, "nation").collect()]  # the listings of a small fixed network

    def fetch(url: str) -> bytes:
        if url.endswith("collinfo.json"):
            return json.dumps([{"id": f"CC-MAIN-2024-{w}"} for w in ("26", "22", "18", "10")]).encode()
        if url.endswith("warc.paths.gz"):
            return "\n".join(f"{url.split('.org/')[1].rsplit('/', 1)[0]}/{k}.warc.gz" for k in keys).encode()
        if url.endswith("dewiki"):
            return b"<a>20240501/</a><a>20240601/</a><a>20240701/</a><a>latest/</a>"
        done = "20240601" in url or "20240501" in url
        return json.dumps({"jobs": {download.ARTICLES: {"status": "done" if done else "waiting", "files": {f"dewiki-{k}.xml.bz2": {} for k in keys} | {"dewiki-index.txt.bz2": {}}}}}).encode()

    crawl = download.crawl_files(download.crawl_listings("2024-15", "2024-24", fetch=fetch), fetch)
    wiki = download.dump_files("de", fetch=fetch)
    papers = download.paper_files("\n".join(f"2024/01/01 00:00:00 123 src/arXiv_{k}.tar" for k in keys) + "\n2024/01/01 00:00:00 5 src/manifest.xml")
    return spark.createDataFrame([(kind, u) for kind, us in (("crawl", crawl), ("wiki", wiki), ("papers", papers)) for u in us], "kind string, url string")


# --- pipelines, presets, resumption


_W = sql.SCORES["word_count"]


@query("pipeline_from_spec", f"SELECT doc_id, md5(regexp_replace(text, '(?i)https?://\\S+|www\\.\\S+', '', 'g')) AS h FROM documents WHERE {_W} BETWEEN 60 AND 100000 AND {sql.SCORES['numbers']} <= 0.15 AND {sql.SCORES['distinct_lines']} >= 0.7")
def pipeline_from_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"name": "clean", "steps": [{"step": "word_count", "least": 60}, {"step": "numbers"}, {"step": "distinct_lines"}, {"step": "modify", "fn": "remove_urls"}]}
    out = pipeline.Pipeline.from_spec(json.dumps(spec)).run(read_table(spark, sf_dir, "documents")).df
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("pipeline_counts", f"SELECT '1. word_count' AS step, count(*) FILTER (WHERE {_W} BETWEEN 50 AND 100000) AS n FROM documents UNION ALL SELECT '2. numbers', count(*) FILTER (WHERE {_W} BETWEEN 50 AND 100000 AND {sql.SCORES['numbers']} <= 0.15) FROM documents")
def pipeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of a run has kept."""
    steps = [pipeline.STEPS[s]() for s in ("word_count", "numbers")]
    result = pipeline.Pipeline("counted").add(*steps).run(read_table(spark, sf_dir, "documents").select("doc_id", "text"), count=True)
    return spark.createDataFrame([*result.metrics.items()], "step string, n long")


@query("preset_exact", ORACLE_SQL["exact_dedup"])
def preset_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.preset("exact", id_col="doc_id").run(read_table(spark, sf_dir, "documents")).df


@query("preset_heuristic_english", ORACLE_SQL["cascade_english_full"])
def preset_heuristic_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.preset("heuristic_english").run(read_table(spark, sf_dir, "documents")).df.select("doc_id")


@query("preset_heuristic_other", ORACLE_SQL["cascade_other_full"])
def preset_heuristic_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.preset("heuristic_other").run(read_table(spark, sf_dir, "documents")).df.select("doc_id")


@query("resumed_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return pipeline.resume(orders, orders.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("resumed_files", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey >= 2")
def resumed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of three regions are left when a manifest has those of two as done."""
    at, manifest = _place(spark, "input"), _place(spark, "done")
    read_table(spark, sf_dir, "nation").repartition(1).write.partitionBy("n_regionkey").parquet(at)
    todo = pipeline.resumable_files(spark, at, manifest)
    pipeline.record_done(spark, [f for f in todo if "n_regionkey=0" in f or "n_regionkey=1" in f], manifest)
    return spark.read.parquet(*pipeline.resumable_files(spark, at, manifest)).select("n_nationkey", "n_name")


@query("sharded_rows", "SELECT o_orderkey, 1 AS shards FROM orders")
def sharded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four shards hold each row exactly once."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    parts = [pipeline.shard(orders, k, 4, "o_orderkey") for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("o_orderkey").agg(F.count(F.lit(1)).cast("int").alias("shards"))


# --- streams


@query("stream_ingest", f"SELECT doc_id, {_W}::INT AS words FROM documents WHERE {_W} >= 50")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as a stream, in micro-batches of two, through a rule into a sink; a second run finds nothing to do."""
    source, target, state = (_place(spark, x) for x in ("stream-in", "stream-out", "stream-state"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # files of bounded size, their row groups small enough that a batch of two has many tasks
    docs.repartition(max(4, docs.count() // 50_000)).write.option("parquet.block.size", 16 << 20).parquet(source)
    rule = lambda df: df.select("doc_id", text.word_count(F.col("text")).cast("int").alias("words")).where("words >= 50")
    for _ in range(2):
        ingest.ingest(spark, source, "doc_id long, text string", rule, target, state, files_per_trigger=2).awaitTermination()
    return spark.read.parquet(target)


@query("stream_windows", ORACLE_SQL["windowed_counts"])
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts of a stream whose whole result each batch replaces."""
    return _streamed(spark, sf_dir, ingest.windowed_counts)


@query("stream_sessions", ORACLE_SQL["sessions"])
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda df: ingest.sessions(df, late="1000 days"))


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    source, target, state = (_place(spark, x) for x in ("events-in", "events-out", "events-state"))
    events = read_table(spark, sf_dir, "events")
    events.repartition(3).write.parquet(source)
    stream = make(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source))
    put = lambda df, _: df.write.mode("overwrite").parquet(target)
    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key of a stream, with a watermark wider than the data so that none comes twice."""
    source, target, state = (_place(spark, x) for x in ("dedup-in", "dedup-out", "dedup-state"))
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(source)
    stream = ingest.deduplicated(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source), ["user_id", "event_type"], "ts", "10000 days")
    stream.select("user_id", "event_type").writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


# --- scores, models and generated text


@query("histogram_score", "SELECT doc_id, CASE WHEN length(text) > 0 THEN (length(st) - length(translate(st, 'etaoinshrdlu .', ''))) / length(text)::DOUBLE END AS score FROM (SELECT *, " + sql.STRIP.replace("(s,", "(text,") + " AS st FROM documents)")
def histogram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", text.histogram(F.col("text"), "etaoinshrdlu .").alias("score"))


@query("model_lengths", "SELECT doc_id, least(length(text), 500)::INT AS n FROM documents")
def model_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's result for each text, in batches of like length, inputs cut, nulls kept from it."""
    return models.infer(read_table(spark, sf_dir, "documents").select("doc_id", "text"), lambda: lambda batch: [len(t) for t in batch], "n", "int", batch=64, max_chars=500).select("doc_id", "n")


@query("center_cropped_model", "SELECT doc_id, length(text[greatest(length(text) // 2 - 100, 0) + 1 : least(length(text) // 2 + 100, length(text))])::INT AS n FROM documents")
def center_cropped_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.functions import modify

    cropped = read_table(spark, sf_dir, "documents").select("doc_id", modify.center_crop(F.col("text"), 100).alias("text"))
    return models.infer(cropped, lambda: lambda batch: [len(t) for t in batch], "n", "int").select("doc_id", "n")


@query("math_scores", "SELECT event_id, greatest(least(value / 30, 5), 0) AS finemath_scores, round_even(greatest(least(value / 30, 5), 0), 0)::INT AS finemath_int_scores FROM events WHERE value IS NOT NULL")
def math_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", "value")
    return models.edu_scores(df, F.col("value") / 30, "finemath_scores", "finemath_int_scores", "label").select("event_id", "finemath_scores", "finemath_int_scores")


@query("poisoned_instructions", "SELECT event_id, value / 100 >= 0.5 AS is_poisoned FROM events")
def poisoned_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", models.poison_flag(F.col("value") / 100).alias("is_poisoned"))


@query("prompt_complexity", """
SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'Open QA' ELSE 'Chat' END AS task_type_1,
  round(0.35 * (p_size / 50.0) + 0.25 * 0.5 + 0.15 * 0.1 + 0.15 * 0.2 + 0.05 * 0.4 + 0.05 * 0.0, 5) AS prompt_complexity_score FROM part""")  # fmt: skip
def prompt_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.struct(
        F.when(F.col("p_size") % 2 == 0, "Open QA").otherwise("Chat").alias("task_type_1"), (F.col("p_size") / 50.0).alias("creativity_scope"), F.lit(0.5).alias("reasoning"), F.lit(0.1).alias("constraint_ct"),
        F.lit(0.2).alias("domain_knowledge"), F.lit(0.4).alias("contextual_knowledge"), F.lit(0.0).alias("number_of_few_shots"),
    )
    return models.complexity(read_table(spark, sf_dir, "part"), heads).select("p_partkey", "task_type_1", "prompt_complexity_score")


@query("embedded_texts", "SELECT doc_id, round((length(text) / sqrt(length(text) * length(text) + 9.0))::FLOAT::DOUBLE, 5) AS x, round((3 / sqrt(length(text) * length(text) + 9.0))::FLOAT::DOUBLE, 5) AS y FROM documents WHERE text IS NOT NULL")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in embedder of two numbers; embeddings come out at length 1."""
    got = models.embed(read_table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"), lambda: lambda batch: [[float(len(t)), 3.0] for t in batch])
    return got.select("doc_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"), F.round(F.col("embedding")[1].cast("double"), 5).alias("y"))


@query("pooled_states", "SELECT p_partkey, (1.0 + p_size) / 2 AS mean_x, p_size::DOUBLE AS last_x FROM part")
def pooled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of three tokens, the last one masked."""
    x = F.col("p_size").cast("double")
    states, mask = F.array(F.array(F.lit(1.0), x), F.array(x, x), F.array(F.lit(99.0), x)), F.array(F.lit(1), F.lit(1), F.lit(0))
    return read_table(spark, sf_dir, "part").select("p_partkey", models.pooled(states, mask)[0].alias("mean_x"), models.pooled(states, mask, "last_token")[0].alias("last_x"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


for _task, _prompt in synthetic.PROMPTS.items():
    _head, _, _tail = _prompt.partition("{document}")

    @query(f"generated_{_task}", f"SELECT doc_id, md5(upper('Be brief.' || chr(10) || chr(10) || {_quoted(_head)} || text || {_quoted(_tail)})) AS h FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7F]')")
    def _generated(spark: SparkSession, sf_dir: str, prompt: str = _prompt) -> DataFrame:
        """The task's prompt around each ASCII text, answered by a stand-in that writes it in capitals."""
        docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").isNotNull() & ~F.col("text").rlike("[^\\x00-\\x7F]"))
        out = synthetic.generate(docs, lambda: lambda batch: [t.upper() for t in batch], prompt, system="Be brief.")
        return out.select("doc_id", F.md5(F.col("generated").cast("binary")).alias("h"))


@query("generated_rows", "SELECT i AS id, 'Ask in Welsh.' AS text FROM range(200) t(i)")
def generated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.generate_rows(spark, lambda: lambda batch: batch, "Ask in {language}.", ["Welsh"], 200).select("id", "text")


@query("appended_questions", "SELECT doc_id, md5(text || chr(10) || chr(10) || 'Question: Who? ' || doc_id || chr(10) || 'Answer: Nobody.') AS h FROM documents WHERE text IS NOT NULL")
def appended_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = F.concat(F.lit(synthetic.QA_PREFIX + "\n- Question: Who? "), F.col("doc_id").cast("string"), F.lit("\n\nAnswer: Nobody.\n"))
    t = synthetic.append_questions(F.col("text"), qa, F.col("doc_id"))
    return read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(t.cast("binary")).alias("h"))


@query("ocr_questions", """
SELECT p_partkey, unnest(['read', 'find', 'count', 'all']) AS kind, unnest([p_name, '[' || p_size || ', 0, ' || (p_size + 10) || ', 5]', '1', p_name]) AS answer FROM part""")  # fmt: skip
def ocr_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about one verified text of each part; a second one fails verification."""
    item = lambda t, match: F.struct(t.alias("text"), F.col("p_size").alias("x0"), F.lit(0).alias("y0"), (F.col("p_size") + 10).alias("x1"), F.lit(5).alias("y1"), F.lit(match).alias("bbox_match"), F.lit(0).alias("text_errors"))
    df = read_table(spark, sf_dir, "part").select("p_partkey", synthetic.keep_verified(F.array(item(F.col("p_name"), 9), item(F.lit("wrong"), 2))).alias("items"))
    return synthetic.ocr_questions(df, key_col="p_partkey").select("p_partkey", F.explode("pairs").alias("p")).select("p_partkey", "p.kind", "p.answer")


@query("translation_resumed", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'have ' || doc_id ELSE upper(lang) END AS t FROM documents WHERE lang IS NOT NULL")
def translation_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have a translation keep it; the others get one and come together with them."""
    have = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("have "), F.col("doc_id").cast("string"))).otherwise(" ")
    todo, done = synthetic.untranslated(read_table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang", have.alias("translated_text")))
    fresh = models.infer(todo, lambda: lambda batch: [t.upper() for t in batch], "translated_text", "string", "lang")
    return synthetic.restore(fresh, done).select("doc_id", F.col("translated_text").alias("t"))


@query("translation_output", "SELECT n_nationkey, upper(n_name) AS text, '{\"target_lang\":\"de\",\"source\":\"' || n_name || '\",\"translation\":\"' || upper(n_name) || '\"}' AS translation_metadata FROM nation")
def translation_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("text"), F.upper("n_name").alias("translated_text"))
    return synthetic.format_output(df, "both", target="de")


# --- recordings


def _wav(frames, channels: int, rate: int, silent=None, loud: str = ""):
    """A WAV file of 16-bit silence, or of ``silent`` frames and then loud ones: header by its rules, little-endian numbers from hexadecimal ones."""
    def little(x, n: int):
        h = F.lpad(F.hex(x.cast("long")), 2 * n, "0")
        return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))

    size, n = frames * (2 * channels), lambda v: F.lit(v)
    head = F.concat(F.lit("52494646"), little(size + 36, 4), F.lit("57415645666D7420"), little(n(16), 4), little(n(1), 2), little(n(channels), 2), little(n(rate), 4), little(n(rate * 2 * channels), 4), little(n(2 * channels), 2), little(n(16), 2), F.lit("64617461"), little(size, 4))
    body = F.repeat(F.lit("\0\0"), ((frames if silent is None else silent) * channels).cast("int")).cast("binary")
    return F.concat(F.unhex(head), body, *([] if silent is None else [F.unhex(F.repeat(F.lit(loud), ((frames - silent) * channels).cast("int")))]))


@query("wave_durations", "SELECT p_partkey, p_size * 20 / 8000.0 AS duration, 8000 AS sample_rate, 2 AS channels, 1 AS mono_channels FROM part")
def wave_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration, rate and channels of stereo recordings, and channels after mixing."""
    df = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", _wav(F.col("p_size") * 20, 2, 8000).alias("content"))
    df = df.withColumn("info", audio.wave_info("content")).withColumn("mono", audio.wave_info(audio.to_mono("content")))
    return df.select("p_partkey", "info.*", F.col("mono.channels").alias("mono_channels"))


@query("relative_segments", "SELECT conv_id, turn, greatest(0, least(50, turn * 10 - 5))::DOUBLE AS start, greatest(0, least(50, turn * 10 + 3 - 5))::DOUBLE AS stop FROM conversations")
def relative_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.struct((F.col("turn") * 10).cast("double").alias("start"), (F.col("turn") * 10 + 3).cast("double").alias("end"))
    got = segments.relative(F.array(seg), F.lit(5.0), F.lit(55.0))[0]
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", got["start"].alias("start"), got["end"].alias("stop"))


@query("joined_pieces", "SELECT conv_id, string_agg(w, ' ' ORDER BY turn) AS text, max(turn * 100 + 0.5)::DOUBLE AS last_start FROM (SELECT conv_id, turn, 'w' || turn AS w FROM conversations) GROUP BY conv_id")
def joined_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of pieces of a recording joined, their words' times shifted by where each piece starts."""
    w = F.concat(F.lit("w"), F.col("turn").cast("string"))
    piece = F.struct("turn", F.concat(F.lit(" "), w).alias("text"), (F.col("turn") * 100).cast("double").alias("offset"), F.array(F.struct(w.alias("word"), F.lit(0.5).alias("start"), F.lit(1.0).alias("end"))).alias("words"))
    df = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return df.select("conv_id", segments.join_pieces(F.col("pieces")).alias("x")).select("conv_id", "x.text", F.array_max(F.transform("x.words", lambda x: x["start"])).alias("last_start"))


@query("filtered_windows", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN 1 ELSE 2 END AS kept, CASE WHEN p_size <= 20 THEN 100.0 ELSE 100.0 + 90.0 END::DOUBLE AS kept_duration FROM part")
def filtered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows of each part, of 100 and 90 seconds; small parts' overlap by more than half, and the one nearer to 120 stays."""
    start = F.when(F.col("p_size") <= 20, F.lit(10.0)).otherwise(F.lit(300.0))
    window = lambda a, b: F.struct(F.array(F.struct(a.alias("start"), b.alias("end"))).alias("segments"))
    df = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.array(window(F.lit(0.0), F.lit(100.0)), window(start, start + 90)).alias("windows"))
    return audio.filter_windows(df, 50.0).select("p_partkey", F.size("kept_windows").alias("kept"), "kept_duration")


@query("pairwise_wer", "SELECT n_nationkey, round(100.0 / (2 + n_regionkey), 4) AS wer FROM nation")
def pairwise_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two or more words differs."""
    from millrace.functions import edits

    same = F.repeat(F.lit(" w"), F.col("n_regionkey") + 1)
    return read_table(spark, sf_dir, "nation").select("n_nationkey", edits.pair_error_percent(F.concat(F.lit("one"), same), F.concat(F.lit("two"), same)).alias("wer"))


@query("prepared_segments", "SELECT conv_id, 'a' AS speaker, 0.0::DOUBLE AS start, 8.0::DOUBLE AS stop, 'so it goes.' AS text FROM (SELECT DISTINCT conv_id FROM conversations)")
def prepared_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of one speaker of eight seconds stays, a short one of another goes."""
    word = lambda w, a, b: F.struct(F.lit(w).alias("word"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    aligned = F.array(F.struct(F.lit(0.0).alias("start"), F.lit("a").alias("speaker"), F.array(word("so", 0.0, 2.0), word("it", 2.0, 5.0), word("goes.", 5.0, 8.0)).alias("words")),
                      F.struct(F.lit(9.0).alias("start"), F.lit("b").alias("speaker"), F.array(word("no.", 9.0, 10.0)).alias("words")))
    df = read_table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("aligned", aligned)
    return audio.module_segments(df).select("conv_id", F.explode("prepared").alias("p")).select("conv_id", "p.speaker", F.col("p.start").alias("start"), F.col("p.end").alias("stop"), "p.text")
