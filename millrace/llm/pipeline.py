"""The corpus pipeline: raw documents to mixed, tokenised training data, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; all but the last return the columns of documents. ``run`` writes each stage's rows to the
shared folder as Parquet and reads them back for the next.

Stages read the columns of documents only, whatever others ``docs`` has and however they are called.
Nulls, empty texts, long texts, ties, repeated rows and an empty table are treated as each stage's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, jaccard_join, language_id, mixing, queries, token_output

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or empty text, or no letter in it) go; with no labelled text at all, that is everything.

    Null ids and languages are no reason to go. Repeated rows are judged one by one and alike; texts are read whole.
    """
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    return language_id.predict(docs.select(*COLUMNS), model).where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows with one doc_id are one document: all of them stay or go, repeated rows too. Rows without an id, and texts without a word, stay.
    """
    found = jaccard_join.near_duplicates(docs.select("doc_id", "text"), k=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go, each row by its own text; texts without a word stay."""
    benchmark = common.table(spark, sf_dir, "benchmark", ["item_id", "text"])
    rest = ("lang", "source", "n_chars")
    found = decontaminate.contamination(docs.select("doc_id", "text", *rest), benchmark, keep=rest, keep_text=True)
    return found.where("not contaminated").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, a document taken in part counting as taken; those never taken go.

    Rows with one id (or none) and as many words are interchangeable: each comes as often as the one taken most. Texts without a word are never taken.
    """
    taken = mixing.mix(docs.select("doc_id", "text", "source"))
    copies = taken.where("taken > 0").groupBy("doc_id", "size").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    rows = docs.select(*COLUMNS, mixing.words("text").alias("words"))
    rows = rows.join(copies.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("words") == F.col("size")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' digests: a row per row of the mix, in the order of the files' ids (nulls first); a null text has the end id alone."""
    return token_output.token_table(docs.select("doc_id", "text"), queries.tokenizer_file("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_output", tokens),
]

#: SQL can express neither the language model nor the tokenizer; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
