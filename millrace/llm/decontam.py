"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers are normalised to words; every run of ``window``
words (or a shorter item as a whole) is a pattern, with a letter of the
automaton's alphabet for each word. A text is normalised the same way and
scanned once; matches are mapped back to the original.
"""

from __future__ import annotations

import re
from itertools import repeat
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.scratch import materialize
from millrace.core.session import read_table

from ._rows import add_columns, texts

#: Words in a pattern.
WINDOW = 10
#: Bytes that one automaton may take in a Python worker, by the estimate of ``weight``. A larger
#: benchmark is dealt over several automata, and the documents are scanned by each in turn.
MAX_AUTOMATON_BYTES = 256_000_000
#: Estimate of what a pattern takes besides its nodes, and a node. Words that one automaton can tell apart.
_PATTERN, _NODE, _LETTERS = 400, 90, 1_000_000

_WORD = re.compile("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")
#: Bytes to their normal form: letters in lower case, what separates words as a space.
_NORMAL = bytes(b if b >= 128 or chr(b).isalnum() and b < 128 and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: The last automaton of this worker, with what it was built from.
_LAST: list = []


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def windows(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """All runs of ``window`` words, or the whole of a shorter item."""
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


def weight(text: str, window: int) -> int:
    """What an item adds to an automaton, at most: every word of every window a node."""
    n = len(normal_words(text))
    return max(1, n - window + 1) * (_PATTERN + _NODE * min(n, window)) if n else 0


def _letter(k: int) -> str:
    """A word's letter in the automaton's alphabet: code points from 256, surrogates left out."""
    return chr(k + 256 if k + 256 < 0xD800 else k + 256 + 0x800)


#: The letter of all words that are in no pattern.
_OTHER = chr(1)


class Patterns(NamedTuple):
    """An automaton over words as letters, whose values are (words in the pattern, its items)."""

    auto: ahocorasick.Automaton
    letters: dict[bytes, str]
    names: list[str]


def build(items: list[tuple[str, str]], window: int) -> Patterns | None:
    """The automaton of all windows of some items; None if they have no words."""
    names = sorted({name for name, _ in items})
    index = {n: i for i, n in enumerate(names)}
    letters: dict[bytes, str] = {}
    owners: dict[str, tuple[int, ...]] = {}
    for name, text in items:
        who = index[name]
        for w in windows(normal_words(text), window):
            key = "".join([letters.setdefault(x, _letter(len(letters))) for x in w])
            if who not in (had := owners.get(key, ())):
                owners[key] = (*had, who)
    if not owners:
        return None
    auto = ahocorasick.Automaton()
    for w, who in owners.items():
        auto.add_word(w, (len(w), who))
    auto.make_automaton()
    return Patterns(auto, letters, names)


def _patterns(items: list[tuple[str, str]], window: int) -> Patterns | None:
    if not _LAST or _LAST[0] != (window, items):
        _LAST[:] = [(window, items), build(items, window)]
    return _LAST[1]


def scan(text: str, patterns: Patterns | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Words of a text, its hit runs of words (from, to), and the items found."""
    words = normal_words(text)
    if patterns is None or not words:
        return len(words), [], []
    found = list(patterns.auto.iter("".join(map(patterns.letters.get, words, repeat(_OTHER)))))
    who = {x for _, (_, owners) in found for x in owners}
    runs = _union([(end - n + 1, end + 1) for end, (n, _) in found])
    return len(words), runs, [patterns.names[i] for i in sorted(who)]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _shards(items: DataFrame, id_col: str, text_col: str, limit: int, window: int):
    """Lists of (name, text) whose automaton has at most ``limit`` bytes, one at a time on the driver (an item that alone has more is one list)."""
    part, size, words = [], 0, 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    for r in rows.orderBy("i", "t").toLocalIterator():
        new, n = weight(r.t, window), len(normal_words(r.t))
        if part and (size + new > limit or words + n > _LETTERS):
            yield part
            part, size, words = [], 0, 0
        part.append((r.i, r.t))
        size, words = size + new, words + n
    yield part


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, max_automaton_bytes: int = MAX_AUTOMATON_BYTES,
) -> DataFrame:
    """Add what each document shares with test items.

    ``n_words long``, ``n_hit long`` (words inside any occurrence of a
    pattern), ``hit_words array<struct<start,end>>`` (runs of word numbers),
    ``hit_spans array<struct<start,end>>`` (the same runs as code points of the
    original text) and ``hit_items array<string>`` (ids, sorted as strings).

    Null and empty texts have no words and no hits; items with null or empty
    text have no patterns; a null id counts as the id ""; repeated items and
    rows are harmless; an empty table of either kind gives no hits. Columns of
    these names are replaced. No shuffle: documents are scanned where they are.
    The benchmark is shipped only in shards whose automaton is estimated to take
    ``max_automaton_bytes`` in a Python worker (1.3 MB for 1000 words); with
    more than one shard the documents are written between the scans.
    """
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_words", _SPANS),
        T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
    spark, out = docs.sparkSession, docs
    for k, part in enumerate(_shards(items, id_col, item_text_col, max_automaton_bytes, window)):
        shipped = spark.sparkContext.broadcast(part)

        def run(batch: pa.RecordBatch, shipped=shipped, later=k > 0) -> list[pa.Array]:
            patterns = _patterns(shipped.value, window)
            n, hit, runs, spans, ids = [], [], [], [], []
            old = batch.to_pydict() if later else None
            for i, t in enumerate(texts(batch, text_col)):
                words, r, who = scan(t, patterns)
                if later:
                    r = _union([*((x["start"], x["end"]) for x in old["hit_words"][i]), *r])
                    who = sorted({*old["hit_items"][i], *who})
                at = [m.span() for m in _WORD.finditer(t)] if r else []
                n.append(words)
                hit.append(sum(b - a for a, b in r))
                runs.append([{"start": a, "end": b} for a, b in r])
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in r])
                ids.append(who)
            return [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(runs, _ARROW_SPANS), pa.array(spans, _ARROW_SPANS), pa.array(ids, pa.list_(pa.string()))]

        out = add_columns(materialize(out, "decontam") if k else out, run, fields)
    return out


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9 over all documents and all benchmark items."""
    out = decontaminate(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: DuckDB SQL of the query: every run of words of a pattern's length against all patterns.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS p FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - {WINDOW - 2}))) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT g.doc_id, g.i, g.n, p.item FROM g JOIN p ON g.p = p.p AND g.n = p.n),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN i USING (doc_id)"""
