"""Queries of filters, modifiers, row operators and exact and fuzzy deduplication."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.session import read_table
from millrace.functions import modify, text
from millrace.operators import dedup, filters, rows

from . import sql
from .base import ORACLE_SQL, query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _kept(rule: text.Rule, score: str = "score") -> str:
    parts = [f"{score} {op} {x}" for op, x in ((">=", rule.least), ("<=", rule.most)) if x is not None]
    return " AND ".join(parts)


# one query for each heuristic filter: the score of every document and whether the filter keeps it
for _name, _rule in text.RULES.items():
    if _name in sql.SCORES:
        _sql = f"SELECT doc_id, score, {_kept(_rule)} AS kept FROM (SELECT doc_id, {sql.SCORES[_name]} AS score FROM documents)"
    else:
        _sql = f"SELECT doc_id, score, {_kept(_rule)} AS kept FROM ({sql.top_ngram(int(_name[4]))})"

    @query(f"filter_{_name}", _sql)
    def _filter(spark: SparkSession, sf_dir: str, rule: text.Rule = _rule) -> DataFrame:
        df = _docs(spark, sf_dir).select("doc_id", rule.score(F.col("text")).alias("score"))
        return df.withColumn("kept", rule.keep(F.col("score")))


_CASCADE = [r for r in text.ENGLISH if r in sql.SCORES]
_SCORED = ", ".join(f"{sql.SCORES[r]} AS {r}" for r in _CASCADE)


@query("cascade_english", f"SELECT doc_id FROM (SELECT doc_id, {_SCORED} FROM documents) WHERE " + " AND ".join(_kept(text.RULES[r], r) for r in _CASCADE))
def cascade_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English cascade as far as SQL expresses it."""
    return filters.cascade(_docs(spark, sf_dir), _CASCADE).select("doc_id")


def _whole(rules: tuple[str, ...]) -> str:
    """SQL of a whole cascade: its scores, and the shares of runs of words."""
    cheap = [r for r in (*rules, "bullets") if r in sql.SCORES]
    runs = {**{f"t{r[4]}": (sql.top_ngram(int(r[4])), text.RULES[r].most) for r in rules if r.startswith("top_")}, **{f"d{n}": (sql.repeated_ngram(n), most) for n, most in filters.REPEATED.items()}}
    scored = ", ".join(f"{sql.SCORES[r]} AS {r}" for r in cheap)
    tests = [*(_kept(text.RULES[r], r) for r in cheap), *(f"doc_id IN (SELECT doc_id FROM ({q}) WHERE score <= {most})" for q, most in runs.values())]
    return f"SELECT doc_id FROM (SELECT doc_id, {scored} FROM documents) WHERE " + " AND ".join(tests)


@query("cascade_english_full", _whole(text.ENGLISH))
def cascade_english_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole English cascade, repeated n-grams included."""
    return filters.english_cascade(_docs(spark, sf_dir)).select("doc_id")


@query("cascade_other_full", _whole(text.OTHER))
def cascade_other_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.other_cascade(_docs(spark, sf_dir)).select("doc_id")


@query("filter_duplicate_5gram", sql.repeated_ngram(5))
def duplicate_5gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", filters.duplicate_ngram_share(5)(F.col("text")).alias("score"))


@query("filter_substring", "SELECT doc_id FROM documents WHERE contains(text, 'License')")
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep(_docs(spark, sf_dir), text.substring_at(F.col("text"), "License") == 1).select("doc_id")


@query("filter_inverted", f"SELECT doc_id FROM (SELECT doc_id, {sql.SCORES['word_count']} AS s FROM documents) WHERE NOT (s >= 50 AND s <= 100000)")
def inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.score_filter(_docs(spark, sf_dir), "word_count", invert=True).select("doc_id")


def _modifier(name: str, fn, oracle: str) -> None:
    @query(f"modify_{name}", f"SELECT doc_id, md5({oracle}) AS h FROM documents")
    def run(spark: SparkSession, sf_dir: str, fn=fn) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", F.md5(fn(F.col("text")).cast("binary")).alias("h"))


_LICENSES = ["All rights reserved.", "Released under the MIT License."]
_modifier("urls", modify.remove_urls, r"regexp_replace(text, '(?i)https?://\S+|www\.\S+', '', 'g')")
_modifier("lines", lambda t: modify.remove_lines(t, _LICENSES), f"array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT list_contains({sql._list(_LICENSES)}, s)), chr(10))")
_md = "text"
for _p in (r"\*\*(.*?)\*\*", r"\*(.*?)\*", r"_(.*?)_", r"\[.*?\]\((.*?)\)"):
    _md = f"regexp_replace({_md}, '{_p}', '\\1', 'g')"
_modifier("markdown", modify.remove_markdown, _md)
_modifier("newlines", modify.normalize_newlines, r"regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '(\r\n){3,}', chr(13) || chr(10) || chr(13) || chr(10), 'g')")
_modifier("slice", lambda t: modify.slice_text(t, 5, 105, trim=False), "text[6:105]")
_modifier("center_crop", lambda t: modify.center_crop(t, 50), "text[greatest(length(text) // 2 - 50, 0) + 1 : least(length(text) // 2 + 50, length(text))]")
_modifier("label_line", lambda t: modify.label_line(t, "__label__hq"), "'__label__hq ' || replace(replace(text, chr(10), ' '), '__label__', ' ')")
_modifier("quotation", modify.remove_quotation, f"CASE WHEN length(st) > 2 AND starts_with(st, '\"') AND ends_with(st, '\"') AND (NOT contains(st, chr(10)) OR NOT ends_with(split_part(st, chr(10), 1), '\"')) THEN st[2:length(st) - 1] ELSE text END")
ORACLE_SQL["modify_quotation"] = ORACLE_SQL["modify_quotation"].replace("FROM documents", f"FROM (SELECT *, {sql.STRIP.replace('(s,', '(text,')} AS st FROM documents)")
_POL = f"list_filter(range(1, len({sql.P}) + 1), lambda i: {sql._policy(f'({sql.P})[i]')})"
_modifier(
    "boilerplate", modify.remove_boilerplate,
    f"CASE WHEN contains(lower(text), 'lorem ipsum') THEN '' WHEN len({_POL}) = 0 THEN text WHEN list_max({_POL}) - list_min({_POL}) + 1 = len({_POL}) AND len({_POL}) < len({sql.P}) "
    f"AND (list_min({_POL}) = 1 OR list_max({_POL}) = len({sql.P})) THEN array_to_string(list_filter({sql.P}, lambda p: NOT {sql._policy('p')}), chr(10) || chr(10)) ELSE text END",
)


@query("split_documents", "SELECT doc_id, (i - 1)::INT AS segment_id, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.split_documents(_docs(spark, sf_dir).select("doc_id", "text"), "\n")


@query("join_documents", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def join_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join_documents(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), id_col="conv_id", segment_col="turn")


@query("join_documents_bounded", """
WITH RECURSIVE t AS (SELECT conv_id, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, r, 0 AS seg, n::BIGINT AS len, text AS acc FROM t WHERE r = 1
  UNION ALL SELECT t.conv_id, t.r, CASE WHEN f.len + t.n + 2 <= 2000 THEN seg ELSE seg + 1 END, CASE WHEN f.len + t.n + 2 <= 2000 THEN f.len + t.n + 2 ELSE t.n END,
    CASE WHEN f.len + t.n + 2 <= 2000 THEN acc || chr(10) || chr(10) || t.text ELSE t.text END FROM f JOIN t ON t.conv_id = f.conv_id AND t.r = f.r + 1)
SELECT conv_id, seg AS segment_id, arg_max(acc, r) AS text FROM f GROUP BY conv_id, seg""")  # fmt: skip
def join_documents_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join_documents(read_table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("segment_id"), "text"), id_col="conv_id", max_length=2000)


@query("merge_chunks", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, sum(length(text))::BIGINT AS chars FROM conversations WHERE text NOT IN ('', chr(10)) GROUP BY conv_id HAVING length(string_agg(text, chr(10) ORDER BY turn)) <= 6000")
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.length("text").cast("long").alias("chars"))
    return rows.merge_chunks(df, ["conv_id"], "turn", "text", ["chars"], max_length=6000)


@query("add_id", "SELECT doc_id, 'doc_' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 10, '0') AS new_id FROM documents")
def add_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.add_id(_docs(spark, sf_dir).select("doc_id"), "new_id", "doc", order_by=["doc_id"])


@query("exact_dedup", "SELECT doc_id AS id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r > 1")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(_docs(spark, sf_dir), id_col="doc_id")


@query("exact_dedup_removed", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR text IS NULL")
def exact_dedup_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return dedup.remove_ids(docs, dedup.exact_duplicates(docs, id_col="doc_id"), "doc_id", "id").select("doc_id", "source")


@query("fuzzy_dedup")
def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.fuzzy_duplicates(_docs(spark, sf_dir), id_col="doc_id")


def _fuzzy(bands: int, width: int, seed: int, grams: int, prime: int = (1 << 31) - 1) -> str:
    """SQL of fuzzy deduplication with few hashes: shingles, minima, bands and their closure."""
    rng, k = np.random.RandomState(seed), bands * width
    a, b = rng.randint(1, prime, k).tolist(), rng.randint(0, prime, k).tolist()
    least = ", ".join(f"min((v * {x}::UBIGINT + {y}::UBIGINT) % {prime}) AS m{i}" for i, (x, y) in enumerate(zip(a, b)))
    keys = " UNION ALL ".join(f"SELECT doc_id, {i} AS band, concat_ws(',', {', '.join(f'm{i * width + j}' for j in range(width))}) AS k FROM m" for i in range(bands))
    return f"""
WITH RECURSIVE s AS (
  SELECT doc_id, list_reduce(list_transform(string_split(g, ''), lambda c: unicode(c)::HUGEINT), lambda h, c: (h * 1099511628211 + c) % 18446744073709551616)::UBIGINT AS h
  FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(length(text) - {grams - 2}, 2)), lambda i: text[i:i + {grams - 1}])) AS g FROM documents WHERE length(text) > 0)),
v AS (SELECT DISTINCT doc_id, xor(h, h >> 29) % {prime} AS v FROM s),
m AS (SELECT doc_id, {least} FROM v GROUP BY doc_id),
b AS ({keys}),
e AS (SELECT DISTINCT x.doc_id AS x, y.doc_id AS y FROM b x JOIN b y ON x.band = y.band AND x.k = y.k AND x.doc_id <> y.doc_id),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT a AS id, min(b) AS "group" FROM r GROUP BY a"""


@query("fuzzy_dedup_few_hashes", _fuzzy(3, 4, 7, 8))
def fuzzy_dedup_few_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy deduplication of all documents with three bands of four hashes of eight characters."""
    return dedup.fuzzy_duplicates(_docs(spark, sf_dir), id_col="doc_id", num_hashes=12, char_ngrams=8, bands=3, rows=4, seed=7)


@query("fuzzy_removed", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM ({_fuzzy(3, 4, 7, 8)}) WHERE id <> \"group\")")
def fuzzy_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents but the repeated ones of each fuzzy group."""
    docs = _docs(spark, sf_dir)
    groups = dedup.fuzzy_duplicates(docs, id_col="doc_id", num_hashes=12, char_ngrams=8, bands=3, rows=4, seed=7)
    return dedup.remove_ids(docs, dedup.duplicate_ids(groups), "doc_id", "id").select("doc_id")


@query("language_filter", "SELECT doc_id FROM documents WHERE lower(split_part(lang, '_', 1)) = 'en'")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.language_filter(_docs(spark, sf_dir).withColumn("p", F.lit(1.0)), "p", "lang", "en").select("doc_id")
