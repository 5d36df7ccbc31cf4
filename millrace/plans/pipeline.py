"""Pipelines of steps: a step is a function from DataFrame to DataFrame. Specs, presets, resumption and shards."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.scratch import materialize
from millrace.functions import code, modify, text
from millrace.operators import dedup, filters, rows
from millrace.operators import models as m

Step = Callable[[DataFrame], DataFrame]
STEPS: dict[str, Callable[..., Step]] = {}


def step(name: str, needs: tuple[str, ...] = ()):
    """Register a function (df, **options) as a step; ``needs`` are columns that must be there."""

    def put(fn):
        def make(**options) -> Step:
            def run(df: DataFrame) -> DataFrame:
                if missing := [c for c in needs if c not in df.columns]:
                    raise ValueError(f"{name} needs the columns {missing}")
                return fn(df, **options)

            run.__name__ = name
            return run

        STEPS[name] = make
        return fn

    return put


def _score_filter(df: DataFrame, rule: str, text_col: str = "text", score_col: str | None = None, invert: bool = False, **limits) -> DataFrame:
    r = text.RULES[rule]
    return filters.score_filter(df, text.Rule(r.score, limits.get("least", r.least), limits.get("most", r.most)), text_col, score_col, invert)


for _rule in text.RULES:
    step(_rule)(partial(_score_filter, rule=_rule))


@step("repeated_ngrams")
def _repeated(df: DataFrame, n: int, most: float, text_col: str = "text") -> DataFrame:
    return df.where(filters.duplicate_ngram_share(n)(F.col(text_col)) <= most)


@step("python_comments")
def _comments(df: DataFrame, least: float = 0.01, most: float = 0.85, text_col: str = "text") -> DataFrame:
    return df.withColumn("__s", code.python_comment_share(F.col(text_col))).where(F.col("__s").between(least, most)).drop("__s")


@step("fertility")
def _fertility(df: DataFrame, model: str, least: float = 2.5, text_col: str = "text") -> DataFrame:
    return df.withColumn("__s", code.fertility(F.col(text_col), model)).where(F.col("__s") >= least).drop("__s")


@step("modify")
def _modify(df: DataFrame, fn: str, text_col: str = "text", out: str | None = None, **options) -> DataFrame:
    return df.withColumn(out or text_col, getattr(modify, fn)(F.col(text_col), **options))


step("language_filter")(filters.language_filter)
step("quality_sample")(filters.quality_sample)
step("add_id")(rows.add_id)
step("split_documents")(rows.split_documents)
step("join_documents")(rows.join_documents)
step("token_count")(m.token_count_filter)


@step("exact_dedup")
def _exact(df: DataFrame, text_col: str = "text", id_col: str = "id", remove: bool = True) -> DataFrame:
    ids = materialize(dedup.exact_duplicates(df, text_col, id_col), "exact-ids")
    return dedup.remove_ids(df, ids, id_col, "id") if remove else ids


@step("fuzzy_dedup")
def _fuzzy(df: DataFrame, text_col: str = "text", id_col: str = "id", remove: bool = True, **options) -> DataFrame:
    ids = materialize(dedup.duplicate_ids(dedup.fuzzy_duplicates(df, text_col, id_col, **options)), "fuzzy-ids")
    return dedup.remove_ids(df, ids, id_col, "id") if remove else ids


@step("semantic_dedup")
def _semantic(df: DataFrame, k: int, eps: float = 0.01, id_col: str = "id", vec_col: str = "embedding", remove: bool = True, **options) -> DataFrame:
    from millrace.operators import semantic

    ids = materialize(semantic.semantic_duplicates(df, k, eps, id_col, vec_col, **options).select("id"), "semantic-ids")
    return dedup.remove_ids(df, ids, id_col, "id") if remove else ids


@dataclass
class Result:
    """What a run gives: the last table, and what each step was told to count."""

    df: DataFrame
    metrics: dict[str, Any] = field(default_factory=dict)


@dataclass
class Pipeline:
    """Steps in order. Spark plans them as one query; nothing runs before an action."""

    name: str
    steps: list[Step] = field(default_factory=list)
    description: str = ""

    def add(self, *more: Step | Pipeline) -> Pipeline:
        """Append steps; a pipeline among them gives its own steps."""
        for s in more:
            self.steps += s.steps if isinstance(s, Pipeline) else [s]
        return self

    def describe(self) -> str:
        return "\n".join([f"{self.name}: {self.description}".rstrip(": "), *(f"  {i}. {getattr(s, '__name__', s)}" for i, s in enumerate(self.steps, 1))])

    def run(self, df: DataFrame, count: bool = False) -> Result:
        """Apply all steps; with ``count`` write after each and count rows."""
        if not self.steps:
            raise ValueError("a pipeline needs steps")
        metrics = {}
        for i, s in enumerate(self.steps, 1):
            df = s(df)
            if count:
                df = materialize(df, f"step-{i}")
                metrics[f"{i}. {getattr(s, '__name__', s)}"] = df.count()
        return Result(df, metrics)

    @classmethod
    def from_spec(cls, spec: Mapping | str) -> Pipeline:
        """From a mapping, or JSON of one: name, steps [{"step": name, options...}] or the name of a preset."""
        spec = json.loads(spec) if isinstance(spec, str) else dict(spec)
        if "preset" in spec:
            return preset(spec["preset"], **spec.get("options", {}))
        unknown = [s["step"] for s in spec["steps"] if s["step"] not in STEPS]
        if unknown:
            raise ValueError(f"unknown steps {unknown}")
        return cls(spec.get("name", "pipeline"), [STEPS[s["step"]](**{k: v for k, v in s.items() if k != "step"}) for s in spec["steps"]], spec.get("description", ""))


def _heuristic(names: tuple[str, ...]) -> list[dict]:
    return [*({"step": r} for r in names), *({"step": "repeated_ngrams", "n": n, "most": x} for n, x in filters.REPEATED.items()), {"step": "bullets"}]


def preset(name: str, **options) -> Pipeline:
    """The usual cascades: heuristic_english, heuristic_other, code, language_quality, exact, fuzzy, semantic."""
    specs: dict[str, list[dict]] = {
        "heuristic_english": _heuristic(text.ENGLISH),
        "heuristic_other": _heuristic(text.OTHER),
        "code": [{"step": "python_comments", "least": 0.001}, {"step": "lines_of_code", "least": 5}, {"step": "fertility", "least": 2, **options}],
        "language_quality": [{"step": "language_filter", "score_col": "lang_score", "label_col": "lang"}, {"step": "quality_sample", "score_col": "quality"}],
        "exact": [{"step": "exact_dedup", "remove": False, **options}], "fuzzy": [{"step": "fuzzy_dedup", "remove": False, **options}], "semantic": [{"step": "semantic_dedup", **options}],
    }
    return Pipeline.from_spec({"name": name, "steps": specs[name]})


def resume(df: DataFrame, done: DataFrame | None, key: list[str]) -> DataFrame:
    """What isn't done yet, by the key of finished rows or files."""
    return df if done is None else df.join(done.select(*key).distinct(), key, "left_anti")


def resumable_files(spark: SparkSession, source: str, manifest: str, fmt: str = "parquet") -> list[str]:
    """Files of a folder that a manifest of finished ones doesn't list."""
    have = spark.read.format(fmt).option("recursiveFileLookup", "true").load(source).inputFiles()
    try:
        done = {r.file for r in spark.read.json(manifest).select("file").collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
            raise
        done = set()
    return sorted(set(have) - done)


def record_done(spark: SparkSession, finished: list[str], manifest: str) -> None:
    """Add finished files to the manifest; Spark's commit makes it all or nothing."""
    if finished:
        spark.createDataFrame([(f,) for f in finished], "file string").coalesce(1).write.mode("append").json(manifest)


def shard(df: DataFrame, index: int, total: int, key: str | None = None) -> DataFrame:
    """One of ``total`` parts of the input by a hash of its file, or of a key column."""
    what = F.col(key) if key else F.input_file_name()
    return df.where(F.pmod(F.xxhash64(what), F.lit(total)) == index)


def file_groups(paths: list[tuple[str, int]], per_group: int | None = None, group_bytes: int | None = None, limit: int | None = None) -> list[list[str]]:
    """Files (path, size) in groups by count, or smallest first by size; the first ``limit`` groups."""
    if (per_group is None) == (group_bytes is None):
        raise ValueError("give either a number of files or a size")
    out: list[list[str]] = []
    if per_group:
        names = [p for p, _ in paths]
        out = [names[i : i + per_group] for i in range(0, len(names), per_group)]
    else:
        room = 0
        for p, n in sorted(paths, key=lambda x: (x[1], x[0])):
            if not out or n > room:
                out.append([])
                room = group_bytes
            out[-1].append(p)
            room -= n
    return out[:limit]


def batch_key(paths: list[str]) -> str:
    """A name for a set of files that doesn't depend on their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]
