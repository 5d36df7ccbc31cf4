"""Operators around models that are passed in: classifiers, embedders, language models, tokenizers.

A model is a factory, run once in each Python worker, of a function from a list
of texts to a list of results. Batches may be sorted by length first, so that
a batch holds texts of like size. What is done with a model's output is
Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.session import prepare

Factory = Callable[[], Callable[[list], list]]


def infer(df: DataFrame, factory: Factory, field: str, kind: str, input_col: str = "text", batch: int = 256, max_chars: int | None = None, sort_by_length: bool = True) -> DataFrame:
    """Add ``field``: the model's result for each row's input, cut to ``max_chars``. Nulls don't reach the model and give null."""
    prepare(df.sparkSession)
    df = df.drop(field)
    schema = T.StructType([*df.schema.fields, T.StructField(field, T._parse_datatype_string(kind))])
    at = df.columns.index(input_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        model, arrow = factory(), to_arrow_schema(schema)
        for b in batches:
            given = b.column(at).to_pylist()
            todo = [i for i, x in enumerate(given) if x is not None]
            if sort_by_length:
                todo.sort(key=lambda i: len(given[i]))
            out: list = [None] * len(given)
            for k in range(0, len(todo), batch):
                ix = todo[k : k + batch]
                for i, y in zip(ix, model([given[i][:max_chars] if max_chars else given[i] for i in ix])):
                    out[i] = y
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow.field(field).type)], schema=arrow)

    return df.mapInArrow(run, schema)


def classify(df: DataFrame, factory: Factory, labels: list[str], label_col: str = "label", score_col: str | None = None, keep: list[str] | None = None, max_chars: int | None = None, **options) -> DataFrame:
    """Add the likeliest label, and with ``score_col`` all probabilities; keep rows of some labels."""
    df = infer(df, factory, "__p", "array<double>", max_chars=max_chars, **options)
    names = F.array(*map(F.lit, labels))
    best = F.array_position("__p", F.array_max("__p")).cast("int")
    df = df.withColumn(label_col, F.when(F.col("__p").isNotNull(), F.element_at(names, best)))
    df = df.withColumn(score_col, F.col("__p")) if score_col else df
    df = df.drop("__p")
    return df.where(F.col(label_col).isin(*keep)) if keep else df


def edu_scores(df: DataFrame, raw: Column, float_col: str, int_col: str, label_col: str, cut: float = 2.5) -> DataFrame:
    """A raw score clamped to 0..5, rounded half to even, and a label by the raw one."""
    clamped = F.least(F.greatest(raw.cast("double"), F.lit(0.0)), F.lit(5.0))
    return df.select("*", clamped.alias(float_col), F.bround(clamped).cast("int").alias(int_col), F.when(raw >= cut, "high_quality").when(raw < cut, "low_quality").alias(label_col))


def safety_prompt(template: str, text: Column, max_chars: int) -> Column:
    """A prompt with the text, cut, in the place of ``{text}``."""
    before, after = template.split("{text}")
    return F.concat(F.lit(before), F.substring(text, 1, max_chars), F.lit(after))


def safety_label(response: Column, categories: list[str]) -> Column:
    """``safe``, a category of the second line of an unsafe response, else ``unknown``."""
    lines = F.split(response, "\n")
    first, second = F.trim(lines[0]), F.trim(F.try_element_at(lines, F.lit(2)))
    return F.when(first == "safe", "safe").when((first == "unsafe") & second.isin(*categories), second).otherwise("unknown")


def poison_flag(score: Column, cut: float = 0.5) -> Column:
    return score >= cut


def complexity(df: DataFrame, heads: Column) -> DataFrame:
    """The fields of a struct of task type and complexity dimensions as columns, and their weighted score.

    Fixed values: the weights of the dimensions.
    """
    weights = {"creativity_scope": 0.35, "reasoning": 0.25, "constraint_ct": 0.15, "domain_knowledge": 0.15, "contextual_knowledge": 0.05, "number_of_few_shots": 0.05}
    df = df.withColumn("__h", heads).select("*", "__h.*").drop("__h")
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("prompt_complexity_score", F.round(score, 5))


def embed(df: DataFrame, factory: Factory, field: str = "embedding", max_chars: int | None = None, **options) -> DataFrame:
    """Add an embedding of length 1."""
    from .semantic import normalized

    df = infer(df, factory, field, "array<float>", max_chars=max_chars, **options)
    return df.withColumn(field, normalized(F.col(field)).cast("array<float>"))


def pooled(states: Column, mask: Column, how: str = "mean") -> Column:
    """Mean or last-token pooling of ``array<array<double>>`` under a 0/1 mask; states of masked tokens don't count."""
    zipped = F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda x: x["m"] == 1)
    if how == "last_token":
        return F.element_at(zipped, -1)["s"]
    zero = F.transform(states[0], lambda _: F.lit(0.0))
    total = F.aggregate(zipped, zero, lambda acc, x: F.zip_with(acc, x["s"], lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.greatest(F.size(zipped), F.lit(1)))


def tokenizer(path: str) -> Factory:
    """Token ids of a public tokenizer file (``tokenizers`` JSON or a sentencepiece model)."""
    def make():
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            return lambda batch: [e.ids for e in t.encode_batch(batch, add_special_tokens=False)]
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda batch: sp.encode(batch, num_threads=1)  # there is a worker for each core already

    return make


def tokenize(df: DataFrame, factory: Factory, input_col: str = "text", max_chars: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``, cut to ``max_tokens``."""
    df = infer(df, factory, "input_ids", "array<int>", input_col, max_chars=max_chars)
    if max_tokens:
        df = df.withColumn("input_ids", F.slice("input_ids", 1, max_tokens))
    return df.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def token_count_filter(df: DataFrame, factory: Factory, least: int = 0, most: int | None = None, out: str = "token_count", input_col: str = "text") -> DataFrame:
    """Keep texts whose number of tokens is in the range."""
    count = lambda: (lambda f: lambda batch: [len(x) for x in f(batch)])(factory())
    df = infer(df, count, out, "int", input_col)
    ok = F.col(out) >= least
    return df.where(ok if most is None else ok & (F.col(out) <= most))


def token_chunks(df: DataFrame, factory: Factory, max_tokens: int = 8000, separator: str = "\n\n", text_col: str = "text", chunk_col: str = "chunk_id", count_col: str = "n_tokens") -> DataFrame:
    """One row a chunk of whole paragraphs with at most ``max_tokens`` tokens; a longer paragraph is a chunk of its own.

    Blank paragraphs go; each keeps its separator but the last of the text.
    """
    def make():
        encode = factory()

        def lengths(paras: Iterator[str]) -> Iterator[int]:
            """Tokens of each paragraph, many in one call: of all texts, up to some characters."""
            held, chars = [], 0
            for p in paras:
                held.append(p)
                chars += len(p)
                if chars > 1 << 18:
                    yield from map(len, encode(held))
                    held, chars = [], 0
            if held:
                yield from map(len, encode(held))

        def chunks(batch: list[str]) -> list[list[dict]]:
            out, texts = [], []
            for t in batch:
                parts = t.split(separator)
                texts.append([p if i == len(parts) - 1 else p + separator for i, p in enumerate(parts) if p.strip()])
            sizes = lengths(p for paras in texts for p in paras)
            for paras in texts:
                done: list[dict] = []
                for p, n in zip(paras, sizes):
                    if done and (done[-1]["n"] == 0 or done[-1]["n"] + n <= max_tokens):
                        done[-1] = {"t": done[-1]["t"] + p, "n": done[-1]["n"] + n}
                    else:
                        done.append({"t": p, "n": n})
                out.append(done)
            return out

        return chunks

    df = infer(df, make, "__c", "array<struct<t:string,n:int>>", text_col)
    rest = [c for c in df.columns if c not in {text_col, chunk_col, count_col, "__c"}]
    return df.select(*rest, F.posexplode("__c").alias(chunk_col, "__x")).select(*rest, chunk_col, F.col("__x.t").alias(text_col), F.col("__x.n").alias(count_col))


def quality_model(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = 1 << 14, max_iter: int = 20):
    """A trained stand-in for a quality classifier: hashed words and logistic regression. Returns the fitted model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    train = df.join(labels.select(id_col, F.col(label_col).cast("double").alias("label")), id_col).where(F.col(text_col).isNotNull())
    stages = [RegexTokenizer(inputCol=text_col, outputCol="__words", pattern="\\W+"), HashingTF(inputCol="__words", outputCol="features", numFeatures=features), LogisticRegression(maxIter=max_iter, regParam=0.01)]
    return Pipeline(stages=stages).fit(train)
