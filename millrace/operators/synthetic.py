"""Synthetic data and translation around an injected language model: prompts, post-processing, segments, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import SPACE, let, strip

from .models import Factory, infer

#: Our own wording of the tasks; ``{document}`` is the input.
PROMPTS = {
    "paraphrase": "Rewrite the text below in clear encyclopedic prose. Keep every fact.\n\nText: {document}\n\nRewritten text:",
    "diverse_qa": "Ask up to eight varied questions about the text below and answer each from the text alone. Write 'Question:' and 'Answer:' lines.\n\nText: {document}",
    "distill": "Shorten the text below to its essential content. Keep names, numbers and reasons.\n\nText: {document}\n\nShort text:",
    "extract_knowledge": "Write down what the text below teaches, as connected prose without opinions or greetings.\n\nText: {document}\n\nKnowledge:",
    "knowledge_list": "List the facts in the text below, one a line, each beginning with '- '.\n\nText: {document}\n\nFacts:",
}
QA_PREFIX = "Here are the questions and answers based on the provided text:"
FAITH = ("fluency", "accuracy", "idiomaticity", "terminology", "handling_of_format")


def generate(df: DataFrame, factory: Factory, prompt: str, input_col: str = "text", output_col: str = "generated", system: str | None = None) -> DataFrame:
    """Fill the prompt's ``{document}`` and add what the model writes."""
    before, _, after = prompt.partition("{document}")
    head = f"{system}\n\n{before}" if system else before
    df = df.withColumn("__prompt", F.concat(F.lit(head), F.col(input_col), F.lit(after)))
    return infer(df, factory, output_col, "string", "__prompt").drop("__prompt")


def generate_rows(spark, factory: Factory, prompt: str, languages: list[str], n: int, seed: int = 0) -> DataFrame:
    """n generated rows; a seeded hash of the row number picks the language for ``{language}``."""
    lang = F.element_at(F.array(*map(F.lit, languages)), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(len(languages))) + 1).cast("int"))
    df = spark.range(n).withColumn("language", lang).withColumn("__prompt", F.replace(F.lit(prompt), F.lit("{language}"), F.col("language")))
    return infer(df, factory, "text", "string", "__prompt").drop("__prompt")


def knowledge_list(t: Column) -> Column:
    """Lines of a list: the first goes unless it is an item; item marks and two-space indents go; null is ""."""
    line = lambda s: F.when(F.startswith(s, F.lit("- ")) | F.startswith(s, F.lit("  ")), strip(F.substring(s, F.lit(3), F.length(s)))).otherwise(s)
    parts = F.split(F.coalesce(t, F.lit("")), "\n")
    parts = F.when(F.startswith(parts[0], F.lit("-")), parts).otherwise(F.slice(parts, 2, F.size(parts)))
    return F.array_join(F.transform(parts, line), "\n")


def append_questions(text: Column, qa: Column, key: Column, prefix: str = QA_PREFIX, most: int = 10, seed: int = 0) -> Column:
    """A document and up to ``most`` of its question-answer pairs, in an order and a number that a hash of ``key`` draws.

    Lines before the first question, or none, make the whole result "".
    """
    lines = F.filter(F.transform(F.split(qa, "\n"), strip), lambda s: s != "")
    lines = F.transform(lines, lambda s: F.when(F.startswith(s, F.lit("- ")), strip(F.substring(s, F.lit(3), F.length(s)))).otherwise(s))
    lines = F.when(F.try_element_at(lines, F.lit(1)) == prefix, F.slice(lines, 2, F.size(lines))).otherwise(lines)
    starts = F.filter(F.transform(lines, lambda s, i: F.when(F.startswith(s, F.lit("Question:")), i + 1)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines) + 1))
    pairs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.array_join(F.slice(lines, x["a"], x["b"] - x["a"]), "\n"))
    drawn = F.transform(F.array_sort(F.transform(pairs, lambda p, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), p.alias("p")))), lambda x: x["p"])
    n = (F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(most)) + 1).cast("int")
    good = (F.size(starts) > 0) & (F.try_element_at(starts, F.lit(1)) == 1)
    return F.when(good, F.concat(text, F.lit("\n\n"), F.array_join(F.slice(drawn, 1, n), "\n\n"))).otherwise(F.lit(""))


def translatable(line: Column) -> Column:
    """Whether a line has a letter and is neither a tag nor JSON."""
    s = strip(line)
    json = (F.startswith(s, F.lit("{")) & F.endswith(s, F.lit("}"))) | (F.startswith(s, F.lit("[")) & F.endswith(s, F.lit("]")))
    return s.rlike(r"\p{L}") & ~(F.startswith(s, F.lit("<")) & F.endswith(s, F.lit(">"))) & ~(json & F.try_parse_json(s).isNotNull())


def segment(df: DataFrame, id_col: str, text_col: str = "text", mode: str = "coarse", least_chars: int = 0, skip_col: str | None = None) -> DataFrame:
    """One row a unit to translate: ``segment_id``, ``segment``; and ``separator``, ``translate`` to put the text together again.

    ``coarse`` units are lines, ``fine`` ones sentences with the space behind
    them. Joining segments and separators in order gives the text back. Null
    texts and rows with a skip mark have one empty unit.

    Every unit carries the document's other columns, the text too: drop it
    before translating, or a document of n units sends it n times.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    if mode == "coarse":
        parts = F.split(t, "\n", -1)
        units = F.transform(parts, lambda s, i: F.struct(s.alias("s"), F.when(i < F.size(parts) - 1, "\n").otherwise("").alias("sep")))
    else:
        pieces = F.filter(F.split(t, f"(?<=[.!?。！？])(?=[{SPACE}])|(?<=\n)(?=[^\n])", -1), lambda s: s != "")
        lead = lambda s: F.regexp_extract(s, f"^[{SPACE}]*", 0)
        tail = lambda s: F.regexp_extract(s, f"[{SPACE}]*$", 0)
        unit = lambda s, sep: F.struct(s.alias("s"), sep.alias("sep"))
        mid = lambda s, e: F.substring(s, F.length(e["a"]) + 1, F.greatest(F.length(s) - F.length(e["a"]) - F.length(e["z"]), F.lit(0)))
        cut = lambda s: let(F.struct(lead(s).alias("a"), tail(s).alias("z")), lambda e: F.array(unit(F.lit(""), e["a"]), unit(mid(s, e), e["z"])))
        units = F.flatten(F.transform(pieces, lambda s: F.when(strip(s) == "", F.array(unit(F.lit(""), s))).otherwise(cut(s))))
        units = F.filter(units, lambda u: (u["s"] != "") | (u["sep"] != ""))
        units = let(units, lambda u: F.when(F.size(u) == 0, F.array(unit(F.lit(""), F.lit("")))).otherwise(u))
    skip = F.coalesce(F.col(skip_col).cast("string"), F.lit("0")) != "0" if skip_col else F.lit(False)
    units = F.when(skip, F.array(F.struct(t.alias("s"), F.lit("").alias("sep")))).otherwise(units)
    out = df.withColumn("__skip", skip).select("*", F.posexplode(units).alias("segment_id", "__u")).withColumn("segment", F.col("__u.s")).withColumn("separator", F.col("__u.sep"))
    return out.withColumn("translate", ~F.col("__skip") & translatable(F.col("segment")) & (F.length("segment") >= least_chars)).drop("__u", "__skip")


def translate(df: DataFrame, factory: Factory) -> DataFrame:
    """Add ``translated``: what the model makes of units to translate; the others stay as they are."""
    df = infer(df.withColumn("__in", F.when(F.col("translate"), F.col("segment"))), factory, "__out", "string", "__in")
    return df.withColumn("translated", F.coalesce("__out", "segment")).drop("__in", "__out")


def reassemble(segments: DataFrame, id_col: str, output_col: str = "translated_text", error_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """One row a document: its translated units in order, errors joined, times summed."""
    rest = [c for c in segments.columns if c not in {id_col, "segment_id", "segment", "separator", "translate", "translated", error_col, time_col}]
    unit = F.struct("segment_id", F.concat(F.coalesce("translated", F.lit("")), "separator").alias("t"))
    out = [F.array_join(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["t"]), "").alias(output_col), *(F.first(c, ignorenulls=True).alias(c) for c in rest)]
    if error_col:
        err = F.transform(F.array_sort(F.collect_list(F.struct("segment_id", F.col(error_col).alias("e")))), lambda x: x["e"])
        out.append(F.array_join(F.filter(err, lambda e: F.coalesce(F.trim(e) != "", F.lit(False))), "; ").alias("translation_errors"))
    if time_col:
        out.append(F.coalesce(F.sum(time_col), F.lit(0.0)).alias("translation_time"))
    return segments.groupBy(id_col).agg(*out)


def untranslated(df: DataFrame, column: str = "translated_text") -> tuple[DataFrame, DataFrame]:
    """Rows to translate and rows that have a translation."""
    done = F.coalesce(F.trim(F.col(column)) != "", F.lit(False))
    return df.where(~done), df.where(done)


def restore(translated: DataFrame, skipped: DataFrame) -> DataFrame:
    return translated.unionByName(skipped, allowMissingColumns=True)


def faith_average(scores: list[Column]) -> Column:
    """Mean of the scores that aren't 0 (0: doesn't apply); 0 if all are."""
    some = F.filter(F.array(*(F.coalesce(s.cast("double"), F.lit(0.0)) for s in scores)), lambda x: x != 0)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some)).otherwise(F.lit(0.0))


def faith_filter(df: DataFrame, threshold: float = 2.5, average_col: str = "faith_avg", failed_col: str = "faith_parse_failed") -> DataFrame:
    """Keep rows that reach the threshold, whose scores couldn't be read, or that weren't scored."""
    return df.where((F.col(average_col) >= threshold) | F.coalesce(F.col(failed_col), F.lit(False)) | F.col(average_col).isNull())


def merge_scores(metadata: Column, scores: Column) -> Column:
    """Scores (a map of strings to doubles) put into a JSON object's ``faith_scores``; what isn't an object becomes one."""
    old = F.coalesce(F.from_json(metadata, "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    rest = F.map_filter(old, lambda k, _: k != "faith_scores")
    return F.to_json(F.map_concat(rest, F.create_map(F.lit("faith_scores"), F.to_json(scores))))


def format_output(df: DataFrame, mode: str = "replaced", text_col: str = "text", output_col: str = "translated_text", target: str = "xx") -> DataFrame:
    """``replaced``: the translation takes the text's place; ``raw``: JSON of the translation beside it; ``both``."""
    raw = F.to_json(F.struct(F.lit(target).alias("target_lang"), F.col(text_col).alias("source"), F.col(output_col).alias("translation")))
    if mode in {"raw", "both"}:
        df = df.withColumn("translation_metadata", raw)
    if mode in {"replaced", "both"}:
        df = df.withColumn(text_col, F.col(output_col)).drop(output_col)
    return df


def keep_verified(items: Column, least_match: int = 5, most_errors: int = 0) -> Column:
    """OCR items whose box match is high and whose text errors are few enough."""
    return F.filter(items, lambda x: (x["bbox_match"] >= least_match) & (x["text_errors"] <= most_errors))


def ocr_questions(df: DataFrame, items_col: str = "items", key_col: str = "id", seed: int = 0) -> DataFrame:
    """Question-answer pairs from OCR items (text, x0, y0, x1, y1): read a box, find a text's box, count, read all.

    A hash of the key draws the item that is asked about. Rows without items have none.
    """
    items = F.col(items_col)
    n = F.size(items)
    one = F.try_element_at(items, (F.pmod(F.xxhash64(F.lit(seed), key_col), F.greatest(n, F.lit(1))) + 1).cast("int"))
    box = F.format_string("[%d, %d, %d, %d]", *(one[c].cast("int") for c in ("x0", "y0", "x1", "y1")))
    same = F.size(F.filter(items, lambda x: x["text"] == one["text"]))
    qa = lambda q, a, kind: F.struct(F.lit(kind).alias("kind"), q.alias("question"), a.alias("answer"))
    pairs = F.array(
        qa(F.concat(F.lit("What is written in the box "), box, F.lit("?")), one["text"], "read"),
        qa(F.concat(F.lit("Where does \""), one["text"], F.lit("\" stand?")), F.when(same == 1, box), "find"),
        qa(F.concat(F.lit("How often does \""), one["text"], F.lit("\" occur?")), same.cast("string"), "count"),
        qa(F.lit("Read all text."), F.array_join(F.transform(items, lambda x: x["text"]), "\n"), "all"),
    )
    none = F.expr("cast(array() as array<struct<kind:string,question:string,answer:string>>)")
    return df.withColumn("pairs", F.when(n > 0, F.filter(pairs, lambda p: p["answer"].isNotNull())).otherwise(none))


def nested(column: Column, path: str) -> Column:
    """Values under a dotted path with ``*`` for all items, of structs and arrays; always an array of strings."""
    steps = path.split(".") if path else []

    def walk(c: Column, rest: list[str]) -> Column:
        if not rest:
            return F.array(c.cast("string"))
        if rest[0] == "*":
            return F.flatten(F.transform(c, lambda x: walk(x, rest[1:])))
        return walk(c[rest[0]], rest[1:])

    return walk(column, steps)
