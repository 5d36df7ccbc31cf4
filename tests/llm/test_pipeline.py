"""The pipeline's stages, each against its operator's brute force on the rows its predecessor kept."""

from __future__ import annotations

import importlib.util
import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from millrace.llm import bpe, lines, registry
from test_decontam import brute_force as decontam_rows
from test_near_dedup import brute_force as near_rows


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage kept, written and read as the driver does."""
    sf_dir, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{out}/{k}")
        kept.append(spark.read.parquet(f"{out}/{k}"))
    return kept


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.schema.simpleString() == steps[0].schema.simpleString()


def test_language_keeps_clean_documents(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    for r in steps[0].collect():
        if r.doc_id not in kept:
            assert not any(c.isalpha() for c in r.text or "")


def test_line_dedup(steps, duck):
    want = duck(lines.oracle(keep="doc_id, kept"), "/root/testdata/sf0.001", {"documents": steps[1].toPandas()})
    got = {r.doc_id: r for r in steps[2].collect()}
    assert {i: r.text for i, r in got.items()} == {int(i): None if pd.isna(t) else t for i, t in want.itertuples(index=False)}
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


def test_near_dedup(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert {r.doc_id for r in steps[3].collect()} == {i for i, _, _, kept in near_rows(rows, 80) if kept}


def test_near_dedup_keeps_one_row_of_each_group(spark, sf_small):
    """Ids that repeat with other texts, equal rows, and copies without an id."""
    schema = spark.read.parquet(f"{sf_small}/documents.parquet").schema
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    copied, alone, twice, nameless, mixed = map(text, range(5))
    rows = [
        (1, copied), (2, copied + " end"), (2, alone), (2, copied),  # id 2 has a text of its own, too
        (3, twice), (3, twice), (3, twice + " end"), (None, nameless), (None, nameless), (None, nameless + " end"),
        (None, mixed), (7, mixed), (8, ""), (8, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(4)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_small).collect()]
    group = lambda t: (t or "").removesuffix(" end")
    assert sorted(group(t) for _, t in got if t) == sorted([copied, alone, twice, nameless, mixed])
    assert {(1, copied), (2, alone), (7, mixed)} <= {*got}
    assert sum(not t for _, t in got) == 3  # without a word, so in no group


def test_decontamination(steps, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in steps[3].collect()]
    assert {r.doc_id for r in steps[4].collect()} == {g[0] for g in decontam_rows(rows, items) if not g[5]}


def test_tokens(steps):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    rows = {r.doc_id: r.text or "" for r in steps[4].collect()}
    got = steps[5].collect()
    assert {r.doc_id for r in got} == rows.keys()
    for r in got:
        assert r.ids == lib.encode(rows[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.round_trip


def test_run_gives_the_last_stage(steps, spark):
    key = lambda r: (r.doc_id, r.n_tokens, tuple(r.ids))
    assert sorted(map(key, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) == sorted(map(key, steps[5].collect()))


def test_odd_documents(spark, sf_small):
    """Nulls, empty texts, repeated rows and an empty table pass through all stages."""
    schema = spark.read.parquet(f"{sf_small}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "the house and the garden are here", None, None, 3), (2, "the house and the garden are here", None, None, 3)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_small)
        assert {r.doc_id for r in docs.collect()} <= {2}


def test_registered():
    spec = importlib.util.spec_from_file_location("entry_under_test", Path(corpus_pipeline.__file__).parent / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = set(entry.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
