"""DuckDB SQL of the text scores, written from their definitions."""

from __future__ import annotations

from millrace.functions.text import COMMON, ELLIPSES, POLICY
from millrace.functions.text import URL as _URL

_WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


W = f"list_filter(string_split_regex(text, '[{_WS}]+'), lambda w: w <> '')"
L = f"list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^{_WS}]'))"
P = "string_split(text, chr(10) || chr(10))"
STRIP = f"regexp_replace(regexp_replace(s, '^[{_WS}]+', ''), '[{_WS}]+$', '')"
CHARS = "length(array_to_string({0}, ''))"


def _count(pattern: str, of: str = "text") -> str:
    return f"len(regexp_extract_all({of}, {_q(pattern)}))"


def _share(part: str, whole: str, empty: str = "NULL") -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part}) / ({whole})::DOUBLE WHEN {whole} = 0 THEN {empty}::DOUBLE END"


def _size(items: str, var: str, test: str) -> str:
    return f"len(list_filter({items}, lambda {var}: {test}))"


def _policy(p: str) -> str:
    return "(" + " OR ".join(f"contains(lower({p}), {_q(x)})" for x in POLICY) + ")"


def _distinct(items: str) -> str:
    """Distinct items in any order: counts and total lengths don't depend on it."""
    return f"list_distinct({items})"


_SYMBOL = f"list_contains({_list([e for e in ELLIPSES])}, w) OR {_count('#+', 'w')} / length(w)::DOUBLE > 0.5"
_ELLIPSIS = " OR ".join(f"ends_with(lower({STRIP}), {_q(e)})" for e in ELLIPSES)

SCORES: dict[str, str] = {
    "non_alpha_numeric": _share(f"length(text) - {_count('[a-zA-Z0-9\n?!,.]')}", "length(text)", "1.0"),
    "symbols_to_words": _share(_size(W, "w", _SYMBOL), f"len({W})"),
    "numbers": _share(_count("[0-9]"), "length(text)", "1.0"),
    "urls": _share(CHARS.format(f"regexp_extract_all(text, {_q(_URL)})"), "length(text)", "1.0"),
    "bullets": _share(_size(L, "s", f"regexp_matches({STRIP}, '^[•‣⁃⁌⁍∙○●◘◦⦾⦿]')"), f"len({L})"),
    "white_space": _share(_count("[\t\n\r\x08 ]"), "length(text)", "1.0"),
    "parentheses": _share(_count(r"[(){}\[\]⟨⟩]"), "length(text)", "1.0"),
    "longest_word": f"list_max(list_transform({W}, lambda w: length(w)))::DOUBLE",
    "word_count": f"len({W})::DOUBLE",
    "boilerplate": f"CASE WHEN contains(lower(text), 'lorem ipsum') THEN 1.0 ELSE {_share(_size(P, 'p', _policy('p')), f'len({P})', '0.0')} END",
    "mean_word_length": _share(CHARS.format(W), f"len({W})"),
    "without_end_mark": _share(_size(L, "s", f"NOT regexp_matches({STRIP}, {_q('[.?!\"' + chr(39) + ']$')})"), f"len({L})"),
    "ellipsis_lines": _share(_size(L, "s", _ELLIPSIS), f"len({L})"),
    "common_words": f"least({_size(W, 'w', f'list_contains({_list(COMMON)}, w)')}, 2)::DOUBLE",
    "words_with_alphabets": _share(_size(W, "w", r"regexp_matches(w, '\p{L}')"), f"len({W})"),
    "pornographic_urls": f"(len(list_filter(regexp_extract_all(text, {_q(_URL)}), lambda u: contains(u, 'porn'))) > 0)::INT::DOUBLE",
    "distinct_lines": _share(f"len({_distinct(L)})", f"len({L})"),
    "distinct_paragraphs": _share(f"len({_distinct(P)})", f"len({P})"),
    "distinct_line_chars": _share(CHARS.format(_distinct(L)), CHARS.format(L)),
    "distinct_paragraph_chars": _share(CHARS.format(_distinct(P)), CHARS.format(P)),
    "lines_of_code": "(length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE",
    "xml_header": "contains(text[1:100], '<?xml version=')::INT::DOUBLE",
    "alpha_share": _share(_count(r"\p{L}"), "length(text)"),
}


def top_ngram(n: int) -> str:
    """Query of the share of the most frequent n-gram of each document."""
    return f"""
WITH d AS (SELECT doc_id, text, {W} AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})),
c AS (SELECT doc_id, g, count(*) AS k FROM g GROUP BY doc_id, g),
b AS (SELECT doc_id, g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, g) AS r FROM c) WHERE r = 1)
SELECT doc_id, CASE WHEN len(w) < {n} THEN 1.0 ELSE (length(text) - length(replace(text, g, ''))) / length(text)::DOUBLE END AS score FROM d LEFT JOIN b USING (doc_id)"""


def repeated_ngram(n: int) -> str:
    """Query of the share of characters in n-grams that the document has had before, overlaps counted once."""
    return f"""
WITH d AS (SELECT doc_id, text, {W} AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(list_transform(w, lambda s: length(s))) AS n FROM d),
u AS (SELECT doc_id, j, sum(n) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM x UNION ALL SELECT doc_id, 0, 0 FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - {n - 2})) AS i, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM d WHERE len(w) >= {n}),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS r FROM g),
f AS (SELECT doc_id, i, least({n}, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {n})) AS k FROM r WHERE r > 1),
c AS (SELECT f.doc_id, sum(b.upto - a.upto + k - 1)::DOUBLE AS chars FROM f JOIN u a ON a.doc_id = f.doc_id AND a.j = i + {n - 1} - k JOIN u b ON b.doc_id = f.doc_id AND b.j = i + {n - 1} GROUP BY f.doc_id)
SELECT doc_id, CASE WHEN len(w) < {n} THEN 1.0 ELSE coalesce(chars, 0) / length(text) END AS score FROM d LEFT JOIN c USING (doc_id)
UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"""
