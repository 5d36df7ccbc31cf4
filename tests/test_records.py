"""Segments, audio, clips, interleaved rows and semantic deduplication against plain Python."""

from __future__ import annotations

import io
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.core.graph import connected_components
from millrace.functions import edits
from millrace.operators import audio, dedup, interleaved, rows, segments, semantic, video
from millrace.plans import registry

SEG = "array<struct<start:double,end:double,speaker:string,text:string>>"


def _segs(spark, *lists):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lists)], f"i int, segments {SEG}")


def _random(seed, n=30):
    rng = random.Random(seed)
    return [(s, s + rng.choice([0.2, 1, 3, 8]), rng.choice("ab"), rng.choice(["", "hi", "yo"])) for s in (rng.randint(0, 60) / 2 for _ in range(n))]


def test_overlaps_against_all_pairs(spark):
    lists = [_random(k) for k in range(8)] + [[], [(0.0, 1.0, "a", "x")]]
    df = _segs(spark, *lists).select("i", segments.overlapping(F.col("segments"), 0.5).alias("bad"))
    for r in df.collect():
        x, want = lists[r.i], set()
        for a in range(len(x)):
            for b in range(a + 1, len(x)):
                inside = min(x[a][1], x[b][1]) - max(x[a][0], x[b][0])
                holds = (x[a][0] <= x[b][0] and x[a][1] >= x[b][1]) or (x[b][0] <= x[a][0] and x[b][1] >= x[a][1])
                if inside > 0 and (inside >= 0.5 or holds):
                    want |= {a, b}
        assert set(r.bad) == want


def test_gaps_and_merging(spark):
    df = _segs(spark, [(2.0, 3.0, "a", ""), (5.0, 6.0, "b", ""), (6.5, 7.0, "b", "")], [])
    got = df.select(segments.add_gaps(F.col("segments"), F.lit(10.0)).alias("g"), segments.gaps(F.col("segments"), F.lit(10.0), 1.5).alias("p"), segments.merge(F.col("segments"), 0.5).alias("m")).collect()
    assert [(s.start, s.end, s.speaker) for s in got[0].g] == [(0, 2, "no-speaker"), (2, 3, "a"), (3, 5, "no-speaker"), (5, 6, "b"), (6, 6.5, "no-speaker"), (6.5, 7, "b"), (7, 10, "no-speaker")]
    assert [(s.start, s.end) for s in got[0].p] == [(0, 1.5), (1.5, 2), (3, 4.5), (4.5, 5), (6, 6.5), (7, 8.5), (8.5, 10)]
    assert [(s.start, s.end) for s in got[0].m] == [(2, 3), (5, 7)]
    assert [(s.start, s.end) for s in got[1].g] == [(0, 10)] and got[1].m == []


def test_snippets(spark):
    x = [(0.0, 4.0, "a", "one"), (5.0, 9.0, "a", "two"), (20.0, 21.0, "a", ""), (40.0, 60.0, "b", "long"), (61.0, 61.2, "b", "s")]
    r = segments.plan_snippets(_segs(spark, x), max_duration=10, min_duration=0.5, max_gap=3).first()
    assert [(s.start, s.end, s.text, len(s.segments)) for s in r.snippets] == [(0, 9, "one two", 2)]
    assert (r.too_long, r.too_short, r.no_text) == (1, 1, 1)
    assert [(s.start, s.end) for s in r.snippets[0].segments] == [(0, 4), (5, 9)]


def test_times_map_back(spark):
    df = _segs(spark, [(1.0, 2.0, "a", ""), (10.0, 13.0, "a", "")]).withColumn("m", segments.concat_offsets(F.col("segments"), 0.5))
    at = lambda a, b: df.select(segments.to_original(F.col("m"), F.lit(a), F.lit(b)).alias("o")).first().o
    assert tuple(at(1500, 2500)) == (10000, 11000) and tuple(at(0, 400)) == (1000, 1400)
    assert at(500, 2000) is None and at(1050, 1400) is None and at(5, 5) is None


def test_words_go_to_segments(spark):
    rows_ = [(_w("a b c", 0.0), [(0.0, 1.6, "x", ""), (1.6, 3.0, "y", "")])]
    df = spark.createDataFrame(rows_, f"alignment array<struct<word:string,start:double,end:double>>, segments {SEG}")
    assert [s.text for s in segments.words_to_segments(df).first().aligned] == ["a b", "c"]


def _w(text, start):
    return [(w, start + i, start + i + 1) for i, w in enumerate(text.split())]


def test_training_windows(spark):
    seg = "array<struct<start:double,end:double,speaker:string,text:string,bandwidth:int,words:array<struct<word:string,start:double,end:double>>>>"
    x = [(10.0 * i, 10.0 * i + 10, "ab"[i % 2], "t", 9000, _w("u v w x y z", 10.0 * i)) for i in range(6)] + [(60.0, 70.0, "a", "t", 100, [])]
    r = audio.training_windows(spark.createDataFrame([(16000, x), (8000, x)], f"audio_sample_rate int, segments {seg}"), duration=30, tolerance=0.1).collect()
    assert [(w.segments[0].start, w.segments[-1].end) for w in r[0].windows] == [(0, 33), (10, 43), (20, 53), (30, 60)]
    assert (r[0].lost_bandwidth, r[0].lost_window, r[0].truncations) == (1, 2, 3) and r[1].lost_sample_rate == 7
    kept = audio.filter_windows(audio.training_windows(spark.createDataFrame([(16000, x)], f"audio_sample_rate int, segments {seg}"), duration=30, tolerance=0.1), 0.0, 30).first()
    assert kept.kept_windows == [3]


def test_flags(spark):
    df = spark.createDataFrame([("Thank you.", "", 1.0, "en"), ("a a a a a b", "", 5.0, "en"), ("normal words in a line", "", 3.0, "en"), ("x" * 30, "", 60.0, "de"), ("fine text here", "bad", 1.0, "en"), (" ", "", 1.0, None)], "pred_text string, _skipme string, duration double, language string")
    got = [(r._skipme, r.note) for r in audio.flag_hallucinations(df, ["Thank you"]).collect()]
    assert got == [("Hallucination:hallucination", "hallucination (phrase_match)"), ("Hallucination:hallucination", "hallucination (repeated_ngrams)"), ("", "passed"), ("", "passed"), ("bad", "skipped (flagged)"), ("", "skipped (empty text)")]


def test_edits_against_a_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + (x != y))
        ins, dele, sub = edits.edits(a, b)
        assert ins + dele + sub == d[-1, -1] and ins - dele == len(b) - len(a) and min(ins, dele, sub) >= 0


def _cheapest(a, b):
    """(cost, insertions) by the whole table, the fewest insertions among equal costs."""
    d = [[(j, j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [(i, 0)]
        for j, y in enumerate(b, 1):
            (p, q), (u, v), (s, t) = d[-1][j], row[-1], d[-1][j - 1]
            row.append(min((p + 1, q), (u + 1, v + 1), (s + (x != y), t)))
        d.append(row)
    return d[-1][-1]


def test_edits_by_band_and_equal_ends(monkeypatch):
    rng = random.Random(2)
    for band in (1, 2, 16):
        monkeypatch.setattr(edits, "BAND", band)
        for _ in range(150):
            a = [rng.choice("abc") for _ in range(rng.randint(0, 40))]
            b = [x for x in a if rng.random() > 0.2] + [rng.choice("abc") for _ in range(rng.randint(0, 12))]
            b = b[rng.randint(0, 9) :] if rng.random() < 0.7 else [rng.choice("abc") for _ in range(rng.randint(0, 40))]
            ins, dele, sub = edits.edits(a, b)
            assert (ins + dele + sub, ins) == _cheapest(a, b) and ins - dele == len(b) - len(a) and min(dele, sub) >= 0


def test_word_error_rate_covers_whole_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))) for _ in range(n))) for i, n in enumerate((3, 90, 400, 1500))]
    spark.createDataFrame([*rows, (9, ""), (10, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.QUERIES["word_error_rate"](spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got[9].rate is None and got[10].rate is None
    for i, text in rows:
        ref, hyp = text.split(), text[9:].split()
        cost, ins = _cheapest(ref, hyp)
        dele = ins + len(ref) - len(hyp)
        want = [round(x / len(ref), 4) for x in (cost, ins, dele, cost - ins - dele)]
        assert got[i].tokens == len(ref) and [got[i].rate, got[i].ins_rate, got[i].del_rate, got[i].sub_rate] == want


def _wav(rate=16000, seconds=0.5, freq=1000.0, channels=1):
    t = np.arange(int(rate * seconds)) / rate
    x = np.repeat((np.sin(2 * np.pi * freq * t) * 20000).astype("<i2")[:, None], channels, axis=1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(x.tobytes())
    return out.getvalue()


def test_wave_files(spark):
    df = spark.createDataFrame([(_wav(channels=2),), (b"no",), (None,)], "content binary")
    got = df.select(audio.wave_info("content").alias("i"), audio.bandwidth(F.col("content")).alias("b"), audio.to_mono("content").alias("m")).collect()
    assert (got[0].i.duration, got[0].i.sample_rate, got[0].i.channels) == (0.5, 16000, 2) and 900 <= got[0].b <= 1200
    assert audio._wave(bytes(got[0].m))[0].shape[1] == 1 and got[1].b is None and got[2].m is None


def test_scenes(spark):
    def python(flags):
        out, start = [], 0
        for i, (p, t) in enumerate(zip([0, *flags], flags)):
            if p == 1 and t == 0:
                start = i
            if p == 0 and t == 1 and i:
                out.append((start, i))
        if out and flags[-1] == 0:
            out.append((start, len(flags) - 1))
        return out or [(0, len(flags))]

    rng = random.Random(1)
    flags = [[int(rng.random() < 0.2) for _ in range(20)] for _ in range(30)] + [[0] * 5]
    got = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "i int, f array<int>").select("i", video.scenes(F.col("f")).alias("s")).collect()
    assert {r.i: [tuple(s) for s in r.s] for r in got} == {i: python(f) for i, f in enumerate(flags)}


def test_windows_and_samples(spark):
    got = spark.range(1).select(*(video.frame_windows(F.lit(n), 10, 5).alias(f"n{n}") for n in (3, 10, 24, 26, 40)), video.sample_times(F.array(*map(F.lit, [0.0, 0.4, 0.9, 1.3])), 2.0).alias("t")).first()
    assert [[tuple(w) for w in got[f"n{n}"]] for n in (3, 10, 24, 26, 40)] == [[], [(0, 9)], [(0, 9), (10, 23)], [(0, 9), (10, 19), (20, 25)], [(0, 9), (10, 19), (20, 29), (30, 39)]]
    assert got.t == [0, 1, 2]


def test_interleaved(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 30, 20)
    data = [("s", -1, "metadata", None, None), ("s", 0, "text", "one two", None), ("s", 3, "image", None, png), ("s", 7, "image", None, b"?"), ("t", -1, "metadata", None, None), ("t", 2, "image", None, None)]
    df = interleaved.align(spark.createDataFrame(data, "sample_id string, position int, modality string, text_content string, binary_content binary"))
    got = [(r.sample_id, r.position, r.modality) for r in interleaved.aspect_ratio_filter(df).orderBy("sample_id", "position").collect()]
    assert got == [("s", -1, "metadata"), ("s", 0, "text"), ("s", 1, "image")]
    assert df.columns[:8] == interleaved.SCHEMA.fieldNames()


def test_pairwise_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 6))
    x[5] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.arange(70) % 3
    c[-1] = 9
    df = spark.createDataFrame([(i, int(c[i]), [float(v) for v in x[i]]) for i in range(70)], "id long, centroid int, embedding array<double>").repartition(3)
    ranked = semantic.rank(df, by=[("id", True)])
    got = {r.id: (r.max_id, r.score) for r in semantic.pairwise(ranked, block=8).collect()}
    for i in range(70):
        mine = [j for j in range(i) if c[j] == c[i]]
        if not mine:
            assert got[i] == (i, 0.0)
        else:
            s = x[mine] @ x[i]
            assert got[i][1] == pytest.approx(max(0, s.max()))
            assert got[i][0] == mine[int(s.argmax())]


def test_kmeans_assigns_the_nearest(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(40, 3)) * 0.05 + m for m in ([1, 0, 0], [0, 1, 0], [0, 0, 1])])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)] + [(999, None)], "id long, embedding array<double>")
    got = {r.id: r.centroid for r in semantic.cluster(df, 3).collect()}
    assert len(got) == 120 and all(len({got[i] for i in range(a, a + 40)}) == 1 for a in (0, 40, 80))
    dup = {r.id for r in semantic.semantic_duplicates(df.union(spark.createDataFrame([(500, [float(v) for v in x[0]])], "id long, embedding array<double>")), 3, 1e-6).collect()}
    assert dup & {0, 500} and len(dup & {0, 500}) == 1


def test_components_of_odd_graphs(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300), (None, 5), (401, 400), (400, 401)]
    for parts in (1, 7):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(parts)).collect()}
        assert got == {**{i: 0 for i in range(101)}, **{i: 200 for i in range(200, 260)}, 400: 400, 401: 400}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_exact_and_fuzzy(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until the evening comes and everybody goes home to sleep " * 4
    data = [(5, base), (3, base), (9, base + "x"), (1, "other text entirely, nothing like it, on and on it goes with its own words and letters " * 4), (2, None), (4, None)]
    df = spark.createDataFrame(data, "id long, text string")
    assert {r.id for r in dedup.exact_duplicates(df).collect()} == {5}
    groups = {r.id: r.group for r in dedup.fuzzy_duplicates(df).collect()}
    assert groups == {3: 3, 5: 3, 9: 3}
    assert {r.id for r in dedup.remove_ids(df, dedup.duplicate_ids(dedup.fuzzy_duplicates(df))).collect()} == {3, 1, 2, 4}


def test_rows(spark):
    df = spark.createDataFrame([(1, 0, "a", None), (1, 1, "bb", "m"), (1, 2, "ccc", "n"), (None, 0, "z", "q"), (2, 1, "y", None), (2, 0, "x", None)], "id long, segment_id int, text string, other string")
    assert sorted((r.id, r.text, r.other) for r in rows.join_documents(df, "-").collect()) == [(1, "a-bb-ccc", "m"), (2, "x-y", None)]
    got = sorted((r.id, r.segment_id, r.text) for r in rows.join_documents(df, "-", max_length=4).collect())
    assert got == [(1, 0, "a-bb"), (1, 1, "ccc"), (2, 0, "x-y")]
    assert [r.text for r in rows.split_documents(spark.createDataFrame([("a||b||",)], "text string"), "||").collect()] == ["a", "b", ""]
    with pytest.raises(ValueError):
        rows.add_id(df, "id")
    assert sorted(r.k for r in rows.add_id(df.repartition(3), "k", order_by=["text"]).collect()) == list(range(6))


def test_stars_need_no_rounds_and_chains_do(spark):
    star = [(0, k) for k in range(1, 6)] + [(10, k) for k in range(11, 14)]
    chain = [(k, k + 1) for k in range(20, 29)] + [(40, 42), (41, 42), (0, 1), (1, 2)]
    for edges in (star, chain, star + chain):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        top = {x: x for e in edges for x in e}
        for _ in edges:
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
        assert got == top


def test_buckets_straight_from_texts(spark):
    """Equal signatures share all buckets, unlike texts none, and short or missing texts give what signatures give."""
    t = "the quick brown fox jumps over the lazy dog again and again " * 3
    df = spark.createDataFrame([(1, t), (2, t), (3, "something else altogether " * 9), (4, None), (5, ""), (6, "short")], "id long, text string")
    by = {}
    for r in dedup.text_buckets(df).collect():
        by.setdefault(r.id, {})[r.band] = bytes(r.bucket)
    assert set(by) == {1, 2, 3, 6} and all(len(x) == 20 for x in by.values())
    assert by[1] == by[2] and not set(by[1].items()) & set(by[3].items())
    sig = {r.id: r.signature for r in dedup.minhash_signatures(df).collect()}
    assert sig[1] == sig[2] and sig[4] == sig[5] == [] and len(sig[6]) == 260


def test_resampled_and_cut_recordings(spark):
    from millrace.operators import media

    rate, n = 8000, 8000
    tone = np.round(10_000 * np.sin(2 * np.pi * 440 * np.arange(n) / rate)).astype("<i2")
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(tone.tobytes())
    df = spark.createDataFrame([(1, bytearray(raw.getvalue())), (2, bytearray(b"no")), (3, None)], "i int, content binary")
    got = {r.i: r for r in df.select("i", media.resampled(F.col("content"), 16000).alias("up"), media.cut_wave(F.col("content"), F.lit(0.25), F.lit(0.5)).alias("cut")).collect()}
    with wave.open(io.BytesIO(got[1].up)) as w:
        up = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")
        assert w.getframerate() == 16000 and np.abs(up[::2][100:-100].astype(int) - tone[100:-100]).max() < 200
    with wave.open(io.BytesIO(got[1].cut)) as w:
        assert np.abs(np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").astype(int) - tone[2000:4000]).max() <= 1
    assert got[2].up is None and got[3].up is None and got[2].cut is None and got[3].cut is None


def test_edits_of_alike_texts_need_no_band(monkeypatch):
    """A long text against itself in lower case without its first two characters: few states, no row-by-row band."""
    def never(*_):
        raise AssertionError("row by row")

    monkeypatch.setattr(edits, "_banded", never)
    rng = np.random.RandomState(5)
    text = "".join(rng.choice(list("abcdefgh  ABC"), 60_000))
    upper = sum(c.isupper() for c in text[2:])
    assert edits.edits(text, text[2:].lower()) == (0, 2, upper)
    assert edits.edits("".join(rng.choice(list("!AB"), 30_000)), "") == (0, 30_000, 0)
    mixed = text[:20_000] + "zz" + text[20_000:40_000] + text[40_003:]
    assert edits.edits(text, mixed) == (2, 3, 0)
    assert edits.edits(list(text), list(mixed)) == (2, 3, 0)


def test_token_chunks_encode_many_paragraphs_at_once(spark, tmp_path):
    """Short texts share the calls of a tokenizer; chunks are what they were."""
    from millrace.operators import models

    calls = tmp_path / "calls"

    def factory():
        def encode(batch):
            with open(calls, "a") as f:
                f.write(f"{len(batch)}\n")
            return [p.split() for p in batch]

        return encode

    rows = [(i, "a b\n\nc d e\n\n\n\n" + "f " * (i % 3)) for i in range(100)] + [(100, ""), (101, None)]
    got = models.token_chunks(spark.createDataFrame(rows, "id int, text string").coalesce(1), factory, 4).collect()
    want = []
    for i in range(100):
        want += [(i, 0, 2, "a b\n\n"), *([(i, 1, 3 + i % 3, "c d e\n\n" + "f " * (i % 3))] if i % 3 < 2 else [(i, 1, 3, "c d e\n\n"), (i, 2, 2, "f f ")])]
    assert sorted((r.id, r.chunk_id, r.n_tokens, r.text) for r in got) == want
    assert len(calls.read_text().split()) <= 4


def test_signatures_take_a_part_of_the_plain_time():
    """Minima of linear hashes modulo the prime as by plain arithmetic, in less time than with masks and new arrays."""
    import time

    from millrace.operators.dedup import _signer

    t = "".join(np.random.RandomState(1).choice(list("abcdefgh "), 20_000))
    start = time.process_time()
    got = _signer(260, 24, 42)(t)
    fast = time.process_time() - start
    rng, p = np.random.RandomState(42), (1 << 31) - 1
    a, b = rng.randint(1, p, 260).astype(np.uint64), rng.randint(0, p, 260).astype(np.uint64)
    h = np.zeros(len(t) - 23, dtype=np.uint64)
    code = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    for k in range(24):
        h = h * np.uint64(0x100000001B3) + code[k : k + len(h)]
    h = np.unique((h ^ (h >> np.uint64(29))) % np.uint64(p))
    want = np.array([((x * h + y) % np.uint64(p)).min() for x, y in zip(a, b)])
    assert got.tolist() == want.tolist()
    start = time.process_time()  # the same in wide blocks, with a new array for each step
    for i in range(0, len(h), 512):
        x = a[:, None] * h[None, i : i + 512] + b[:, None]
        x = (x >> np.uint64(31)) + (x & np.uint64(p))
        x = (x >> np.uint64(31)) + (x & np.uint64(p))
        x[x == p] = 0
        x.min(axis=1)
    assert fast < time.process_time() - start


def test_components_send_no_round_to_the_driver(spark):
    """Tables of a round grow with the graph: none is broadcast, however small its files look."""
    from millrace.core.graph import connected_components

    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    edges = spark.range(1, 300).where("id % 50 <> 0").selectExpr("id AS src", "id - 1 AS dst")
    assert {tuple(r) for r in connected_components(edges).collect()} == {(i, i // 50 * 50) for i in range(300)}
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(int(before), runs.size())]
    assert plans and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
