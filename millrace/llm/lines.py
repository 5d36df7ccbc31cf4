"""Line dedup with a log-template tree, in DataFrame functions only.

A line's path in the tree is fixed in depth: its token count, then its leading
tokens (a token with a digit counts as the wildcard ``<*>``). Below its leaf the
line's other tokens are cut into four parts of like length. Lines that agree in
two of the four are one template whose other fields are variable, so a leaf has
as many templates as it needs and unrelated lines in it change nothing. A masked
line is a template, too.

A template is dropped, from all documents, if it recurs in enough witnesses.
Copies of whole documents are not this operator's matter: exact copies count as
one document, and a near copy is no witness. A document is taken for one if most
of its text, cut into small pieces, stands in several others as well.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.scratch import drop_table, materialize
from millrace.core.session import read_table

#: Leading tokens that are part of the path; parts of the tokens below it.
DEPTH, PARTS = 3, 4
#: Witnesses from which a template recurs; for short lines, which have no variable fields, more are needed.
MIN_DOCS, SHORT_DOCS = 5, 40
#: Characters, without spaces and wildcards, under which a line is short, and under which it always stays.
SHORT_CHARS, MIN_CHARS = 12, 3
#: Characters of a piece of text; texts that must hold it so that it is shared (told apart by 64 marks).
PIECE_CHARS, SHARED = 20, 3
#: Share of a text's pieces, by characters, that must not be shared in a witness.
OWN = 1 / 3

#: Keys up to which a list of them is broadcast (under 64 bytes each); a longer one is joined by a shuffle.
BROADCAST_KEYS = 1 << 18
#: Dropped lines of one text up to which its lines are looked up in their list; those of more are joined.
LIST = 64
_WS = " \\t\\r\\f\\x0B"
#: Where texts are cut into pieces: at punctuation, and between words after n or r, so that an edit changes one piece.
_MARKS, _ENDS = "[.,;:!?\\n。，、；：！？।،؟]+", ("n ", "r ", "н ", "р ")
_PAIRS = list(combinations(range(1, PARTS + 1), 2))


def _normal(body: Column) -> Column:
    """Lines as tokens with single spaces between; a token with a digit is ``<*>``. Whole texts at once, in linear time."""
    t = F.regexp_replace(body, f"(?<![^{_WS}\\n])[^0-9{_WS}\\n]*+[0-9][^{_WS}\\n]*+", "<*>")
    return F.transform(F.split(F.regexp_replace(t, f"[{_WS}]{{2,}}|[{_WS[1:]}]", " "), "\n"), lambda x: F.trim(x))


def _digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def _few(df: DataFrame) -> DataFrame:
    """A table of keys, to be broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _lines(texts: DataFrame, depth: int) -> DataFrame:
    """(doc, key, leaf, short, parts, h1 to h4): the distinct lines of each text, with digests of line, path and parts."""
    line, n = F.col("line"), F.size("tokens")
    some = texts.select("doc", F.explode(F.array_distinct(_normal(F.col("body")))).alias("line")).where("line <> ''").select("doc", "line", F.split("line", " ").alias("tokens"))
    some = some.select("doc", "line", "tokens", n.alias("n"), (F.length(F.replace(line, F.lit("<*>"), F.lit(""))) - n + 1).alias("chars")).where(F.col("chars") >= MIN_CHARS)
    parts = F.when(F.col("chars") < SHORT_CHARS, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(PARTS), F.col("n") - depth)))
    some = some.select("doc", "line", "tokens", "n", (F.col("chars") < SHORT_CHARS).alias("short"), parts.alias("parts"))
    begin = lambda k: F.floor((F.col("n") - depth) * k / F.col("parts")).cast("int")
    part = lambda k: F.when(F.col("parts") >= k, F.xxhash64(F.slice("tokens", begin(k - 1) + depth + 1, begin(k) - begin(k - 1)))).otherwise(0)
    leaf = F.xxhash64("n", F.substring_index("line", " ", depth))
    return some.select("doc", _digest(line).alias("key"), leaf.alias("leaf"), "short", "parts", *(part(k).alias(f"h{k}") for k in range(1, PARTS + 1)))


def _masks() -> Column:
    """The ways to keep half of a line's parts: number and digests of the two that are kept (one of two parts)."""
    each = [F.when((F.col("parts") == PARTS) | (F.col("parts") == 3) & F.lit(j <= 3) | (F.col("parts") == 2) & F.lit(j == 3), F.struct(F.lit(k).alias("mask"), F.col(f"h{i}").alias("a"), F.col(f"h{j}").alias("b"))) for k, (i, j) in enumerate(_PAIRS)]
    return F.array_compact(F.array(*each))


def _copies(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``docs`` whose text is mostly shared with other ones of them."""
    cut = F.col("body")
    for end in _ENDS:
        cut = F.replace(cut, F.lit(end), F.lit(end[0] + "\n"))
    found = texts.join(_few(docs), "doc", "left_semi").select("doc", F.explode(F.split(cut, _MARKS)).alias("p")).where(F.length("p") >= PIECE_CHARS)
    pieces = materialize(found.select("doc", F.xxhash64("p").alias("piece"), F.length("p").alias("n")), "line-pieces", "none")
    mark = F.expr("shiftleft(1L, cast(conv(hex(substring(doc, 1, 1)), 16, 10) as int) % 64)")
    shared = pieces.groupBy("piece").agg(F.bit_or(mark).alias("marks")).where(F.bit_count("marks") >= SHARED).select("piece", F.lit(True).alias("shared"))
    # rows of equal texts weigh alike on both sides
    all_ = pieces.join(_few(materialize(shared, "line-shared")), "piece", "left").groupBy("doc").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("shared"), F.col("n"))).alias("n"))
    out = materialize(all_.where(F.col("n") > (1 - OWN) * F.col("total")).select("doc"), "line-copies")
    drop_table(pieces)
    return out


def line_dedup(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS, short_docs: int = SHORT_DOCS) -> DataFrame:
    """Drop lines of recurring templates; add ``n_lines long`` and ``n_dropped long``.

    All other columns pass; ``text_col`` holds what is left, lines joined by LF.
    A null text stays null and has 0 lines; an empty text is one line; lines
    with fewer than ``MIN_CHARS`` characters besides spaces and wildcards (blank
    ones, brackets, numbers) always stay, those under ``SHORT_CHARS`` recur from
    ``short_docs`` witnesses. Rows repeat as they come and count as one document
    if their texts are equal; an empty table stays empty; columns named
    ``n_lines`` or ``n_dropped`` are replaced. Every count covers all documents.
    No text is gathered: lines go as digests (equal ones of 128 bits mean equal
    lines), and each document gets the list of its own dropped lines.
    """
    clash = [c for c in docs.columns if c.lower() in {"n_lines", "n_dropped"}]
    docs = docs.drop(*clash)
    names = docs.columns
    rest = [c for c in names if c.lower() != text_col.lower()]
    src = docs.select(F.struct(F.lit(0), *(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text_col).alias("body")).withColumn("doc", _digest(F.col("body").cast("binary")))
    texts = src.where("body IS NOT NULL").select("doc", "body")

    # lines whose leaf has enough rows, once for each distinct text
    rows = materialize(_lines(texts, depth), "line-rows", "none")
    often = materialize(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_docs).select("leaf"), "line-often")
    once = materialize(rows.join(_few(often), "leaf", "left_semi").distinct(), "line-once")
    drop_table(rows)

    # templates: lines as they are, and groups of lines that agree in half of their parts
    kinds = materialize(once.groupBy("key", "leaf", "short", "parts", *(f"h{k}" for k in range(1, PARTS + 1))).agg(F.count(F.lit(1)).alias("docs")), "line-kinds")
    enough = F.when(F.col("short"), F.lit(short_docs)).otherwise(F.lit(min_docs))
    exact = kinds.where(F.col("docs") >= enough).select("key", F.col("key").alias("template"))
    masked = kinds.where("parts >= 2").select("key", "docs", "leaf", F.explode(_masks()).alias("m")).select("key", "docs", "leaf", "m.*")
    same = ["leaf", "mask", "a", "b"]
    groups = masked.groupBy(*same).agg(F.count(F.lit(1)).alias("keys"), F.sum("docs").alias("docs")).where((F.col("keys") > 1) & (F.col("docs") >= min_docs)).select(*same)
    general = masked.join(groups, same).select("key", _digest(F.concat_ws(" ", *same)).alias("template"))
    templates = materialize(exact.unionByName(general), "line-templates")
    held = materialize(once.join(_few(templates), "key").select("key", "template", "doc", "short"), "line-held")

    # those that recur in witnesses
    copies = _copies(texts, materialize(held.select("doc").distinct(), "line-docs"))
    seen = held.select("template", "doc", "short").distinct().join(_few(copies), "doc", "left_anti")
    recurs = seen.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.max("short").alias("short")).where(F.col("docs") >= enough).select("template")
    recurs = materialize(recurs, "line-recurs")
    mine = held.join(_few(recurs), "template", "left_semi").groupBy("doc").agg(F.collect_set("key").alias("drop"))
    mine = materialize(mine, "line-mine")

    out = src.join(mine, "doc", "left")
    split = F.split("body", "\n")
    pairs = F.arrays_zip(split.alias("raw"), _normal(F.col("body")).alias("line"))
    stays = F.transform(F.filter(pairs, lambda x: ~F.array_contains("drop", _digest(x["line"]))), lambda x: x["raw"])
    done = out.withColumn("left", F.when(F.col("drop").isNotNull() & (F.size("drop") <= LIST), stays).when(F.col("drop").isNull(), split))
    many = mine.where(F.size("drop") > LIST)
    if not many.isEmpty():
        each = texts.dropDuplicates(["doc"]).join(many, "doc").select("doc", F.posexplode(pairs).alias("at", "x")).select("doc", "at", "x.raw", _digest(F.col("x.line")).alias("key"))
        kept = each.join(many.select("doc", F.explode("drop").alias("key")), ["doc", "key"], "left_anti")
        kept = kept.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("kept")).select("doc", F.transform("kept", lambda x: x["raw"]).alias("kept"))
        done = done.join(materialize(kept, "line-kept"), "doc", "left").withColumn("left", F.coalesce("left", "kept", F.when(F.col("body").isNotNull(), F.array().cast("array<string>"))))
    text = F.array_join("left", "\n")
    cols = [text.alias(c) if c.lower() == text_col.lower() else F.col(f"row.`{c}`").alias(c) for c in names]
    count = lambda c: F.when(F.col("body").isNotNull(), F.size(c).cast("long")).otherwise(F.lit(0).cast("long"))
    return done.select(*cols, count(split).alias("n_lines"), (count(split) - count("left")).alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without recurring lines: counts and the digest of what is left."""
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SQL_TOKENS = "list_transform(list_filter(string_split_regex(l, '[ \\t\\r\\f\\x0B]+'), lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END)"
_SQL_PART = "CASE WHEN parts >= {k} THEN array_to_string(t[{d} + ((n - {d}) * ({k} - 1)) // parts + 1:{d} + ((n - {d}) * {k}) // parts], ' ') ELSE '' END AS p{k}"


def oracle(source: str = "documents", keep: str = "doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256") -> str:
    """DuckDB SQL of the query: strings where the plan has digests, no prefilter by leaves, witnesses counted for each template."""
    part = ", ".join(_SQL_PART.format(k=k, d=DEPTH) for k in range(1, PARTS + 1))
    cut = "text"
    for end in _ENDS:
        cut = f"replace({cut}, '{end}', '{end[0]}' || chr(10))"
    pairs = " UNION ALL ".join(f"SELECT line, path, '{i}{j}' AS mask, p{i} AS a, p{j} AS b FROM kinds WHERE parts = {PARTS} OR parts = 3 AND {j} <= 3 OR parts = 2 AND {j} = 3" for i, j in _PAIRS)
    return f"""
WITH src AS (SELECT *, md5(text) AS doc_key FROM {source}),
spl AS (SELECT DISTINCT doc_key, text FROM src WHERE text IS NOT NULL),
lines AS (
  SELECT DISTINCT doc_key, t, array_to_string(t, ' ') AS line FROM (
    SELECT doc_key, {_SQL_TOKENS} AS t FROM (SELECT doc_key, unnest(string_split(text, chr(10))) AS l FROM spl)) WHERE len(t) > 0),
sized AS (SELECT DISTINCT line, t, len(t) AS n, length(replace(array_to_string(t, ''), '<*>', '')) AS chars FROM lines),
cut AS (SELECT line, t, n, chars < {SHORT_CHARS} AS short, CASE WHEN chars < {SHORT_CHARS} THEN 0 ELSE greatest(0, least({PARTS}, n - {DEPTH})) END AS parts FROM sized WHERE chars >= {MIN_CHARS}),
kinds AS (SELECT line, short, parts, n || ' ' || array_to_string(t[1:{DEPTH}], ' ') AS path, {part} FROM cut),
masks AS ({pairs}),
templates AS (
  SELECT line, 'exact' || line AS template FROM kinds
  UNION ALL SELECT line, concat_ws(chr(10), path, mask, a, b) FROM masks),
held AS (SELECT template FROM lines JOIN templates USING (line) JOIN kinds USING (line) GROUP BY template HAVING count(DISTINCT doc_key) >= CASE WHEN bool_or(short) THEN {SHORT_DOCS} ELSE {MIN_DOCS} END),
wanted AS (SELECT DISTINCT doc_key FROM lines JOIN templates USING (line) JOIN held USING (template)),
pieces AS (SELECT doc_key, p FROM (SELECT doc_key, unnest(string_split_regex({cut}, '{_MARKS}')) AS p FROM spl WHERE doc_key IN (SELECT doc_key FROM wanted)) WHERE length(p) >= {PIECE_CHARS}),
shared AS (SELECT p FROM pieces GROUP BY p HAVING count(DISTINCT ('0x' || doc_key[1:2])::INTEGER % 64) >= {SHARED}),
copies AS (SELECT doc_key FROM pieces LEFT JOIN shared ON pieces.p = shared.p GROUP BY doc_key HAVING sum(length(pieces.p)) FILTER (shared.p IS NOT NULL) > {1 - OWN!r}::DOUBLE * sum(length(pieces.p))),
recurs AS (
  SELECT template FROM lines JOIN templates USING (line) JOIN kinds USING (line) WHERE doc_key NOT IN (SELECT doc_key FROM copies)
  GROUP BY template HAVING count(DISTINCT doc_key) >= CASE WHEN bool_or(short) THEN {SHORT_DOCS} ELSE {MIN_DOCS} END),
dropped AS (SELECT DISTINCT line FROM templates WHERE template IN (SELECT template FROM recurs)),
lists AS (SELECT doc_key, list(line) AS gone FROM lines WHERE line IN (SELECT line FROM dropped) GROUP BY doc_key),
res AS (
  SELECT s.*, string_split(s.text, chr(10)) AS ls, CASE WHEN gone IS NULL THEN string_split(s.text, chr(10)) ELSE list_filter(string_split(s.text, chr(10)),
    lambda l: NOT list_contains(gone, array_to_string({_SQL_TOKENS}, ' '))) END AS rest
  FROM src s LEFT JOIN lists USING (doc_key)),
done AS (SELECT *, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(rest), 0) AS n_dropped, array_to_string(rest, chr(10)) AS kept FROM res)
SELECT {keep} FROM done"""
