"""From raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept and returns the columns of documents; the last one returns tokens. A
stage's result is written and read again before the next stage starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.core.scratch import materialize
from millrace.core.session import read_table
from millrace.llm import bpe, decontam, langid, lines, minhash

#: A text whose likeliest language has a lower posterior is rejected.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts of no learned language (null, without a letter, or unsure) go."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines of recurring templates go; every document stays."""
    return lines.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group exactly one row stays, of the smallest id (null comes last).

    A row's key is its id and a digest of all its columns, so rows that share an
    id are told apart, and rows of one key are equal and any of them may stay.
    Texts without a word are in no group and all stay.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    row = F.unhex(F.md5(F.to_json(F.struct(F.struct(*rest).alias("rest"), F.md5("text").alias("text")))))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), row.alias("row"))
    found = minhash.near_duplicates(docs.select(key.alias("key"), "text"), "key").where("n_shingles > 0")
    found = materialize(found.select(F.col("key.row").alias("near_row"), "kept"), "pipeline-near")
    gone = found.where("NOT kept").select("near_row").distinct()
    keyed = docs.withColumn("near_row", row)
    left = keyed.join(materialize(gone, "pipeline-gone"), "near_row", "left_anti")
    again = materialize(found.where("kept").groupBy("near_row").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("near_row"), "pipeline-again")
    if not again.isEmpty():
        one = left.join(again, "near_row", "left_semi").dropDuplicates(["near_row"])
        left = left.join(again, "near_row", "left_anti").unionByName(one)
    return left.select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a passage of a test item go."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: ids of every document, and whether they decode to its text."""
    out = bpe.encode_decode(docs)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("tokens", tokens)]
#: SQL can't express the tokens; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
