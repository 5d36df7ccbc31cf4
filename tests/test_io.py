"""Sources, sinks, pipelines, models and streams."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import models, synthetic
from millrace.plans import pipeline
from millrace.sinks import writers
from millrace.sources import archives, html, readers
from millrace.streaming import ingest


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n", None), (2, None, "x")], "id long, text string, extra string")
    for fmt in ("json", "parquet"):
        writers.write_documents(df, f"{tmp_path}/{fmt}", fmt, ["id", "text"])
        got = readers.read_documents(spark, f"{tmp_path}/{fmt}", fmt, ["text", "id", "nowhere"])
        assert got.columns == ["text", "id"] and sorted((r.id, r.text) for r in got.collect()) == [(1, "é\n"), (2, None)]
        writers.write_documents(df, f"{tmp_path}/{fmt}", fmt, ["id", "text"])
        assert readers.read_documents(spark, f"{tmp_path}/{fmt}", fmt).count() == 4
    with pytest.raises(ValueError):
        readers.read_documents(spark, f"{tmp_path}/json", "xlsx")
    with pytest.raises(ValueError):
        readers.read_documents(spark, f"{tmp_path}/parquet", file_limit=None, schema="id long", pathGlobFilter="none")


def test_token_files(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("more text here",)], "text string").coalesce(1)
    done = writers.write_tokens(df, models.tokenizer(path), f"{tmp_path}/a", 50_257, end=7).collect()
    assert sum(r.documents for r in done) == 3
    assert writers.merge_token_files(f"{tmp_path}/a", f"{tmp_path}/all/x") == 3
    kind, n = writers.read_index((tmp_path / "all/x.idx").read_bytes())
    ids = np.frombuffer((tmp_path / "all/x.bin").read_bytes(), dtype=kind)
    assert kind == "uint16" and n.sum() == len(ids) and n[1] == 1 and (ids[np.cumsum(n) - 1] == 7).all()
    assert ids[: n[0] - 1].tolist() == models.tokenizer(path)()(["hello world"])[0]


def test_tars(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        sample = {"texts": ["a", None, "c"], "images": [None, "p.png", None], "url": "u"}
        for name, body in (("k1.json", json.dumps(sample).encode()), ("p.png", b"PNG")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    got = archives.samples(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, r.modality, r.text_content) for r in got] == [(-1, "metadata", None), (0, "text", "a"), (1, "image", None), (2, "text", "c")]
    filled = archives.materialize_content(archives.samples(spark, str(tmp_path)), str(tmp_path)).where("modality = 'image'").first()
    assert bytes(filled.binary_content) == b"PNG" and filled.materialize_error is None
    members = writers.sample_members(archives.samples(spark, str(tmp_path), contents=True))
    out = writers.write_tars(members, f"{tmp_path}/out", 10).collect()
    assert sum(r.members for r in out) == 2
    again = archives.samples(spark, f"{tmp_path}/out").where("modality = 'text'").orderBy("position").collect()
    assert [r.text_content for r in again] == ["a", "c"]


def _warc(url, body, kind="response"):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"


def test_warc(spark, tmp_path):
    parts = [_warc("http://a", b"<p>one</p>"), _warc("http://q", b"", "request"), _warc("http://b", b"<p>two</p>")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    got = archives.warc(spark, str(tmp_path)).collect()
    assert [(r.url, r.warc_id, r.source_id, bytes(r.content)) for r in got] == [("http://a", "1-2", "x.warc.gz", b"<p>one</p>"), ("http://b", "1-2", "x.warc.gz", b"<p>two</p>")]
    assert archives.warc(spark, str(tmp_path), record_limit=1).count() == 1
    at = len(gzip.compress(parts[0])) + len(gzip.compress(parts[1]))
    ask = spark.createDataFrame([("d/x.warc.gz", at, len(gzip.compress(parts[2]))), ("none.gz", 0, 5)], "warc_filename string, warc_record_offset long, warc_record_length long")
    assert [bytes(r.binary_content) for r in archives.warc_ranges(ask, str(tmp_path)).collect()] == [b"<p>two</p>"]


def test_wiki_and_latex(spark, tmp_path):
    text = "'''Bold''' {{Infobox|a={{b}}}} word<ref>gone</ref> [[File:x.png|thumb]] [[Page|link]] [[Category:Things]]\n== Head ==\n{| table |}\nend __NOTOC__"
    (tmp_path / "w.xml").write_text(f"<mediawiki><page><title>A b</title><ns>0</ns><id>7</id><revision><text>{text.replace('<', '&lt;')}</text></revision></page><page><title>R</title><ns>0</ns><id>8</id><revision><text>#REDIRECT [[A]]</text></revision></page><page><title>T</title><ns>1</ns><id>9</id><revision><text>talk</text></revision></page></mediawiki>")
    r = archives.wiki_pages(spark, str(tmp_path / "w.xml")).collect()
    assert [(x.title, x.id, x.url) for x in r] == [("A b", "7", "https://en.wikipedia.org/wiki/A_b")]
    assert "Bold" in r[0].text and "link" in r[0].text and "Things" in r[0].text and "Head" in r[0].text
    assert not any(x in r[0].text for x in ("Infobox", "gone", "thumb", "table", "NOTOC", "''"))
    tex = "\\newcommand{\\me}{Ann}\npre\n\\section{One}\n% all gone\nText by \\me. 5\\% of it % tail\n\\bibliography{x} after"
    got = archives.latex_text([tex, "no section"])
    assert "Text by Ann. 5\\% of it" in got and not any(x in got for x in ("pre\n", "gone", "tail", "after"))
    assert archives.latex_text(["nothing"]) is None


def test_pages(spark, sf):
    good = "This is the text of the page and it has all the words that you would want to see in a long paragraph of it. " * 3
    page = f"<html lang='en'><body><nav><a href='#'>Home</a> <a href='#'>About</a></nav><h1>Title of it</h1><p>{good}</p><p>short one</p><p>{good}</p><footer>© 2020 the site</footer><script>x</script></body></html>"
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>zzz qqq</p>")], "page_id long, html string")
    for a in html.ALGORITHMS:
        got = html.extract_text(df, algorithm=a).collect()
        assert [r.page_id for r in got] == [1] and got[0].language == "en" and got[0].text.count("all the words") == 6, a
        assert "Home" not in got[0].text and "2020" not in got[0].text
    assert "short one" in html.extract_text(df).first().text  # between good paragraphs
    assert html.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).count() > 0


def test_pipelines(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    p = pipeline.Pipeline.from_spec('{"name": "p", "steps": [{"step": "word_count"}, {"step": "modify", "fn": "remove_urls"}, {"step": "exact_dedup", "id_col": "doc_id"}]}')
    r = p.run(docs, count=True)
    assert list(r.metrics) == ["1. word_count", "2. modify", "3. exact_dedup"] and 0 < r.df.count() <= docs.count()
    assert "2. modify" in p.describe()
    with pytest.raises(ValueError):
        pipeline.Pipeline.from_spec({"steps": [{"step": "nothing"}]})
    with pytest.raises(ValueError):
        pipeline.Pipeline("empty").run(docs)
    assert pipeline.preset("heuristic_english").run(docs).df.count() <= docs.count()
    parts = [pipeline.shard(docs, i, 3, "doc_id").count() for i in range(3)]
    assert sum(parts) == docs.count() and min(parts) > 0
    docs.limit(5).write.parquet(f"{tmp_path}/in")
    todo = pipeline.resumable_files(spark, f"{tmp_path}/in", f"{tmp_path}/done")
    pipeline.record_done(spark, todo, f"{tmp_path}/done")
    assert todo and pipeline.resumable_files(spark, f"{tmp_path}/in", f"{tmp_path}/done") == []
    assert pipeline.resume(docs, docs.limit(3), ["doc_id"]).count() == docs.count() - 3
    assert pipeline.file_groups([("a", 5), ("b", 1), ("c", 4)], group_bytes=5) == [["b", "c"], ["a"]]
    assert pipeline.file_groups([("a", 5), ("b", 1), ("c", 4)], per_group=2, limit=1) == [["a", "b"]]


def test_models(spark):
    df = spark.createDataFrame([(1, "aaa"), (2, None), (3, "b" * 50)], "id long, text string")
    seen = models.infer(df, lambda: lambda b: [len(x) for x in b], "n", "int", max_chars=10).collect()
    assert [(r.id, r.n) for r in seen] == [(1, 3), (2, None), (3, 10)]
    e = models.embed(df, lambda: lambda b: [[3.0, 4.0] for _ in b]).collect()
    assert [r.embedding for r in e] == [pytest.approx([0.6, 0.8]), None, pytest.approx([0.6, 0.8])]
    c = models.token_chunks(spark.createDataFrame([("a b\n\nc d e\n\n\n\nf",)], "text string"), lambda: lambda b: [x.split() for x in b], 3).collect()
    assert [(r.chunk_id, r.text, r.n_tokens) for r in c] == [(0, "a b\n\n", 2), (1, "c d e\n\n", 3), (2, "f", 1)]
    p = spark.range(1).select(models.pooled(F.expr("array(array(1D,2D),array(3D,4D),array(9D,9D))"), F.expr("array(1,1,0)")).alias("m"), models.pooled(F.expr("array(array(1D,2D),array(3D,4D),array(9D,9D))"), F.expr("array(1,1,0)"), "last_token").alias("l")).first()
    assert (p.m, p.l) == ([2.0, 3.0], [3.0, 4.0])


def test_synthetic(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(synthetic.knowledge_list(F.lit("Sure:\n- a\n  b\nc"))) == "a\nb\nc"
    qa = F.lit("Here are the questions and answers based on the provided text:\n- Question: q1\nAnswer: a1\n- Question: q2\nAnswer: a2")
    got = one(synthetic.append_questions(F.lit("doc"), qa, F.lit(1), most=2))
    assert got.startswith("doc\n\nQuestion: q") and one(synthetic.append_questions(F.lit("doc"), F.lit("Answer: x"), F.lit(1))) == ""
    assert got == one(synthetic.append_questions(F.lit("doc"), qa, F.lit(1), most=2))
    lines = ["word", "123", "<tag>", '{"a": "b"}', "{not json}", "[1] x"]
    df = spark.createDataFrame([(s,) for s in lines], "s string").select(synthetic.translatable(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == [True, False, False, False, True, True]
    docs = spark.createDataFrame([(1, "One two. Three!  Four\n\nfive? six"), (2, None), (3, "  lead"), (4, "")], "id long, text string")
    for mode in ("coarse", "fine"):
        s = synthetic.translate(synthetic.segment(docs, "id", mode=mode), lambda: lambda b: [x.upper() for x in b])
        back = {r.id: r.translated_text for r in synthetic.reassemble(s, "id").collect()}
        assert back == {1: "ONE TWO. THREE!  FOUR\n\nFIVE? SIX", 2: "", 3: "  LEAD", 4: ""}
    assert json.loads(one(synthetic.merge_scores(F.lit('{"k": "v"}'), F.create_map(F.lit("fluency"), F.lit(2.0)))))["k"] == "v"


def test_translation_round_trip_sends_no_text_with_a_unit(spark, sf, monkeypatch):
    """Units reach the model without their document's text, and are made once a text."""
    from millrace.plans import record_queries

    sent, infer = [], synthetic.infer
    monkeypatch.setattr(synthetic, "infer", lambda df, *a: sent.append(df) or infer(df, *a))
    got = {r.doc_id: r.h for r in record_queries.translation_round_trip(spark, sf).collect()}
    assert sorted(sent[0].columns) == ["__in", "doc_id", "segment", "segment_id", "separator", "translate"]
    plan = sent[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in texts.items()}


def test_stream(spark, tmp_path):
    schema = "id long, text string"
    run = lambda: ingest.ingest(spark, f"{tmp_path}/in", schema, lambda d: d.where("length(text) > 1"), f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "bb")], schema).write.parquet(f"{tmp_path}/in")
    run()
    run()
    spark.createDataFrame([(3, "cc")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 3]


def test_windows_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    q = ingest.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.window_start, r.event_type): r.n for r in ingest.windowed_counts(events).collect()}
    assert {(r.window_start, r.event_type): r.n for r in spark.table("counts").collect()} == want


def test_entry_without_the_llm_parts(tmp_path):
    """The driver deletes two files' worth: the entry must import and still have the library's own queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(readers.__file__).resolve().parents[2]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_dedup' in q and not any(x.startswith('op') for x in q) and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)


def test_tex_commands_with_nested_braces():
    tex = "\\newcommand*{\\foo}{a {b} c}\n\\def\\bar {\\foo x}\n\\newcommand{\\two}[1]{#1}\n\\def\\loop{\\loop}\nbefore\n\\subsection*[s]{One} \\foo, \\bar; \\foobar 5\\% \\loop % gone\n% line\n\\two{z}\\begin{thebibliography}{9} rest"
    out = archives.latex_text([tex, "no section"])
    assert out.startswith("\\subsection*[s]{One} a {b} c, a {b} c x; \\foobar 5\\% ") and out.endswith("\n\\two{z}") and "gone" not in out and "% line" not in out
    assert archives.latex_text(["nothing here"]) is None and archives.latex_text([]) is None
    assert archives.latex_text(["\\section{a} {unclosed \\foo"]) == "\\section{a} {unclosed \\foo"


def test_wiki_brackets_in_linear_time():
    assert archives.wikitext("a {{b [[c}} d]] e") == "a  d]] e"
    assert archives.wikitext("[[a|b [[c]] d]] {{x") == "b c d {{x"
    assert archives.wikitext("{{" * 20_000 + "x" + "[[" * 20_000).count("{{") == 20_000  # unclosed marks stay
    assert archives.wikitext("{{" * 20_000 + "x" + "}}" * 20_000) == ""


def test_downloads_retry_and_go_on(spark, tmp_path):
    from millrace.sources import download

    marks = str(tmp_path / "marks")

    def fetch(url):
        with open(marks, "a") as f:
            f.write(url + "\n")
        if url.endswith("bad") or open(marks).read().count(url) < 2:
            raise OSError("busy")
        return b"x" * 10

    urls = spark.createDataFrame([("http://h/a",), ("http://h/a",), ("http://h/bad",), (None,)], "url string")
    for _ in range(2):
        got = {r.url: (r.bytes, r.error) for r in download.download(urls, str(tmp_path / "out"), fetch, wait=0.0).collect()}
        assert got == {"http://h/a": (10, None), "http://h/bad": (None, "OSError: busy")}
    assert open(marks).read().count("http://h/a\n") == 2 and len(list((tmp_path / "out").iterdir())) == 1
    assert download.download(urls.limit(0), str(tmp_path / "out"), fetch).collect() == []
    with pytest.raises(ValueError):
        download.crawl_listings("2024-20", "2024-10", fetch=lambda _: b"[]")


def test_merged_lines_keep_their_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join(f'{{"k": {k}, "i": {i}}}\n' for i in range(50)))
    n = writers.merge_lines(spark, str(tmp_path), str(tmp_path / "all.out"))
    lines = (tmp_path / "all.out").read_text().splitlines()
    assert n == 150 and lines == [f'{{"k": {k}, "i": {i}}}' for k in range(3) for i in range(50)]
    assert not list(tmp_path.glob("*.jsonl"))


def test_ranges_of_archives(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: %d\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" % (len(body) + 19) + body + b"\r\n\r\n"
    a, b = record(b"first"), record(b"second")
    (tmp_path / "x.warc").write_bytes(a + b)
    rows = [(1, "p/x.warc", 0, len(a), "old"), (2, "p/x.warc", len(a), len(b), "old"), (2, "p/x.warc", len(a), len(b), "old"), (3, "p/y.warc", 0, 5, "old"), (4, None, None, None, "old")]
    df = spark.createDataFrame(rows, "i int, warc_filename string, warc_record_offset long, warc_record_length long, binary_content string")
    got = archives.warc_ranges(df, str(tmp_path), drop_failed=False)
    assert sorted((r.i, bytes(r.binary_content) if r.binary_content else None) for r in got.collect()) == [(1, b"first"), (2, b"second"), (2, b"second"), (3, None), (4, None)]
    assert archives.warc_ranges(df, str(tmp_path)).count() == 3


def test_rows_for_heavy_work_are_dealt_over_tasks(spark):
    """A small file is one task however many rows it has; recordings and files made of its rows are dealt anew."""
    from millrace.core.session import spread

    df = spark.range(0, 12_001, 1, 1)
    assert [spread(df, n).rdd.getNumPartitions() for n in (5000, 20_000)] == [3, 1]
    assert spread(df.where("id < 0")).count() == 0
    assert spread(df, 1000).agg({"id": "sum"}).first()[0] == 12_000 * 12_001 // 2


@pytest.mark.parametrize(("name", "least"), [("clip_captions", 3), ("speech_segments", 3), ("wave_durations", 3), ("filtered_windows", 3)])
def test_heavy_queries_of_a_small_file_take_several_tasks(spark, sf_small, tmp_path, name, least):
    """12,000 parts in one file of one row group: the rows' work goes to three tasks."""
    from __spark_entry__ import queries

    part = spark.read.parquet(f"{sf_small}/part.parquet")
    n = part.count()
    many = part.crossJoin(spark.range(-(-12_000 // n)).withColumnRenamed("id", "k")).withColumn("p_partkey", F.col("p_partkey") + F.col("k") * 100_000).drop("k")
    many.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() >= least


def test_papers_of_a_small_file_take_several_tasks_and_few_tries(spark, tmp_path, monkeypatch):
    """Tars of at most 500 papers come from tasks of 5000 rows; a file that is no tar is tried as a plain one only."""
    from __spark_entry__ import queries

    n = 12_000
    rows = spark.range(1, n + 1, 1, 1).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type")
    rows.write.parquet(str(tmp_path / "part.parquet"))
    made = []
    write = writers.write_tars
    monkeypatch.setattr(writers, "write_tars", lambda df, *a, **k: made.append(df.rdd.getNumPartitions()) or write(df, *a, **k))
    assert queries()["tex_papers"](spark, str(tmp_path)).count() == n - n // 3 and made[0] >= 3
    modes, opened = [], tarfile.open
    monkeypatch.setattr(tarfile, "open", lambda *a, **k: modes.append(k.get("mode", "r:*")) or opened(*a, **k))
    outer = io.BytesIO()
    with opened(fileobj=outer, mode="w") as tar:
        data = gzip.compress(b"\\section{a}\\\\x \\\\\\b1")
        info = tarfile.TarInfo("1.gz")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert [r["content"] for r in archives.tex_records("x.tar", outer.getvalue())] == [["\\section{a}\\\\x \\\\\\b1"]]
    assert modes[1:] == ["r:"]
    assert list(archives._commands("\\a1\\\\b\\%\\ü\\c\\")) == [(0, "a1", 3), (10, "c", 12)]


def test_members_of_tars_are_read_by_their_ranges(spark, tmp_path):
    """No plan reads a tar's whole content beside a row that wants a member of it; tars are streamed, not held."""
    members = spark.range(500).selectExpr("concat(lpad(id, 4, '0'), '.png') AS name", "cast(repeat(cast(id % 10 AS string), 100) AS binary) AS content").coalesce(1)
    made = writers.write_tars(members, str(tmp_path / "t"), 200).collect()
    assert sorted(r.members for r in made) == [100, 200, 200]
    refs = []
    for r in made:
        with tarfile.open(r.tar) as tar:
            refs += [(m.name, json.dumps({"path": f"file:{r.tar}", "member": m.name, "byte_offset": m.offset_data, "byte_size": m.size})) for m in tar]
    refs += [("gone", json.dumps({"path": "file:/nowhere.tar", "member": "x", "byte_offset": 0, "byte_size": 1})), ("none", json.dumps({"path": f"file:{made[0].tar}", "member": "y"}))]
    df = spark.createDataFrame([(n, "image", None, None, r) for n, r in refs], "sample_id string, modality string, binary_content binary, materialize_error string, source_ref string")
    got = archives.materialize_content(df, str(tmp_path / "t"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.replace("binary_content#", "") and "[path" in plan
    rows = {r.sample_id: r for r in got.collect()}
    assert len(rows) == 502 and rows["gone"].materialize_error == "no such file" and rows["none"].materialize_error == "no such member"
    assert all(bytes(rows[n].binary_content) == n[3].encode() * 100 for n, _ in refs[:500])


def test_archives_of_ranges_are_bounded(spark, tmp_path, monkeypatch):
    """More pages are more archives, not a longer one that a worker must hold."""
    from __spark_entry__ import queries

    spark.range(12_000).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "concat('<p>', id) AS html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    roots, cut = [], archives.warc_ranges
    monkeypatch.setattr(archives, "warc_ranges", lambda df, root, **k: roots.append(root) or cut(df, root, **k))
    got = queries()["warc_ranges"](spark, str(tmp_path))
    assert archives.files(spark, roots[0], "part-*").select("path").count() == 3
    assert got.count() == 12_000


def test_merged_lines_are_written_by_many_tasks(spark, tmp_path):
    """One file in order of name and line, also of a file that is read in several stretches; no stage has one task with all lines."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = {f"{k}.json": [f"{k} {i} é" for i in range(3000 if k == 1 else k)] for k in (2, 0, 1, 3)}
    for name, x in lines.items():
        (tmp_path / name).write_text("\n".join(x) + ("\n" if x and name != "1.json" else ""))
    (tmp_path / "4.json.gz").write_bytes(gzip.compress(b"z\r\ny\n"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("merge", "merge")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
        assert writers.merge_lines(spark, str(tmp_path), str(tmp_path / "all.out")) == 3007
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [x for name in sorted(lines) for x in lines[name]] + ["z", "y"]
    assert (tmp_path / "all.out").read_text() == "\n".join(want) + "\n"
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["all.out"]
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("merge") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize(("name", "table", "rows", "least"), [("split_files", "documents", 100_001, 2), ("stream_ingest", "documents", 250_000, 5), ("wiki_articles", "part", 60_000, 2)])
def test_made_files_are_bounded(spark, tmp_path, monkeypatch, name, table, rows, least):
    """What a query writes to read again is more files when there are more rows, not longer ones from one task."""
    import glob

    from __spark_entry__ import queries
    from millrace.plans import io_queries

    columns = {"documents": ["id AS doc_id", "repeat('a ', 60) AS text"], "part": ["id AS p_partkey", "concat('n ', id) AS p_name", "'b' AS p_brand", "'t' AS p_type"]}
    spark.range(1, rows + 1, 1, 1).selectExpr(*columns[table]).write.parquet(str(tmp_path / f"{table}.parquet"))
    places, place = [], io_queries._place
    monkeypatch.setattr(io_queries, "_place", lambda *a: places.append(place(*a)) or places[-1])
    assert queries()[name](spark, str(tmp_path)).count() == (rows if table == "documents" else rows - rows // 5)
    assert len(glob.glob(f"{places[0]}/part-*")) >= least
