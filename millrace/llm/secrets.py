"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived
that every matching text satisfies. Each block of documents gets an inverted
index of the trigrams that the queries name; intersecting and uniting the
postings leaves candidates, and only these are searched with the expression.
Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.session import read_table

from ._rows import add_columns, texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the length that a group of a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three rules that the contract names come first, in its order.
BASE = (
    Rule("assign", r"(?ia)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # finds the same as runs [0-9a-f]+ of which short ones are dropped
)
RULES = BASE + (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("bearer", r"(?ia)\bbearer\x20+[A-Za-z0-9._~+/-]{20,}"),
)
#: Strings that a part of an expression may stand for before they are turned into trigrams.
_MOST = 64


@dataclass
class _Part:
    """What a part of an expression says: all its strings, or a query (None: nothing)."""

    exact: set[str] | None
    query: tuple | None = field(default=None)


def _grams(strings: set[str]) -> tuple | None:
    """One of the strings occurs, so all its trigrams do."""
    if any(len(s) < 3 for s in strings):
        return None
    return _or([_and([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _and(parts: list) -> tuple | None:
    known = list(dict.fromkeys(p for p in parts if p))
    return None if not known else known[0] if len(known) == 1 else ("and", *known)


def _or(parts: list) -> tuple | None:
    return None if any(p is None for p in parts) else parts[0] if len(parts) == 1 else ("or", *dict.fromkeys(parts))


def _chars(items: list) -> set[str] | None:
    """The lower-case characters of a class, if they are few."""
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 16:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= 16 else None


def _seq(tokens) -> _Part:
    now: set[str] | None = {""}  # strings that the part read so far ends with
    whole, queries = True, []

    def flush() -> None:
        nonlocal now, whole
        queries.append(_grams(now))
        now, whole = {""}, False

    for op, arg in tokens:
        if op is C.AT:
            continue
        if op is C.LITERAL:
            p = _Part({chr(arg).lower()})
        elif op is C.IN:
            p = _Part(_chars(arg))
        elif op is C.SUBPATTERN:
            p = _seq(arg[3])
        elif op is C.BRANCH:
            some = [_seq(x) for x in arg[1]]
            p = _Part(set().union(*(x.exact for x in some))) if all(x.exact is not None for x in some) else _Part(None, _or([x.query if x.exact is None else _grams(x.exact) for x in some]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            p = _seq(inner)
            if p.exact is not None and high is not C.MAXREPEAT and high <= 4 and len(p.exact) ** high <= _MOST:
                p = _Part({"".join(x) for n in range(low, high + 1) for x in product(sorted(p.exact), repeat=n)})
            else:
                p = _Part(None, (p.query if p.exact is None else _grams(p.exact)) if low else None)
        else:
            p = _Part(None)
        if p.exact is not None and len(now) * len(p.exact) <= _MOST:
            now = {a + b for a, b in product(now, p.exact)}
        else:
            flush()
            if p.exact is not None:
                now = set(p.exact)
            else:
                queries.append(p.query)
    if whole:
        return _Part(now)
    queries.append(_grams(now))
    return _Part(None, _and(queries))


def trigram_query(pattern: str) -> tuple | None:
    """A Boolean query of lower-case trigrams that holds for every text with a match; None: no such."""
    p = _seq(parser.parse(pattern))
    return _grams(p.exact) if p.exact is not None else p.query


def _named(query: tuple | None) -> set[str]:
    return set() if query is None else {query[1]} if query[0] == "gram" else set().union(*(_named(q) for q in query[1:]))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EMPTY = np.zeros(0, dtype=np.int64)


class Index:
    """Postings of the named trigrams in a block of texts."""

    def __init__(self, grams: set[str]):
        self.wanted = np.zeros(1 << 24, dtype=bool)
        self.codes = {g: int.from_bytes(g.encode("latin-1"), "big") for g in grams}
        self.wanted[list(self.codes.values())] = True
        self.postings: dict[int, np.ndarray] = {}

    def add(self, block: list[bytes]) -> None:
        """Replace the block. Texts are set apart by bytes that no trigram holds."""
        raw = np.frombuffer(b"\xff\xff".join(block).translate(_LOWER) + b"\xff\xff", dtype=np.uint8)
        ends = np.cumsum([len(t) + 2 for t in block])
        codes = raw[:-2].astype(np.int32) << 16 | raw[1:-1].astype(np.int32) << 8 | raw[2:]
        at = np.flatnonzero(self.wanted[codes])
        pairs = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        grams, starts = np.unique(pairs >> 32, return_index=True)
        self.postings = dict(zip(grams.tolist(), np.split(pairs & 0xFFFFFFFF, starts[1:])))

    def find(self, query: tuple) -> np.ndarray:
        """Texts that satisfy a query."""
        if query[0] == "gram":
            return self.postings.get(self.codes[query[1]], _EMPTY)
        parts = [self.find(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        out = min(parts, key=len)
        for p in parts:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


class Scanner:
    """Rules with their queries, and the index of the block at hand."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.index = Index(set().union(*(_named(q) for _, _, q in self.rules)))

    def scan(self, block: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the (start, rule number, end) of all its secrets, in order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in block]
        self.index.add([t.encode("utf-8", "surrogatepass") for t in block])
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in range(len(block)) if query is None else self.index.find(query).tolist():
                for m in pattern.finditer(block[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in out]


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}
_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``secrets array<struct<kind,start,end>>``: code points, end exclusive.

    Matches of one kind are leftmost and don't overlap; those of different
    kinds may. They are ordered by start, then by the rule's place. Null and
    empty texts have none; rows repeat as they come; an empty table stays
    empty; a column named ``secrets`` is replaced. The index is split by
    documents, so nothing is shuffled and memory is one Arrow batch.
    """
    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        if rules not in _SCANNERS:
            _SCANNERS[rules] = Scanner(rules)
        found = _SCANNERS[rules].scan(texts(batch, text_col))
        return [pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found], _ARROW_FOUND)]

    return add_columns(docs, run, [T.StructField("secrets", _FOUND)])


def redact(docs: DataFrame, text_col: str = "text", found_col: str = "secrets", mark: str = "<SECRET>") -> DataFrame:
    """Replace every found span by ``mark``, overlapping spans by one; null texts stay null."""
    step = lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(
        F.struct(
            F.concat(acc["out"], F.when(x["start"] >= acc["at"], F.concat(F.substring(F.col(text_col), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            x["end"].alias("at"),
        )
    )
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(found_col, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over all documents."""
    out = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", *map(count, kinds), F.sha2(joined(F.filter("secrets", lambda x: x["kind"].isin(kinds))), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
