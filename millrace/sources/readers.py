"""Readers with explicit schemas, and the per-source parsers of question-answer corpora."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SCHEMAS = {
    "labelled": "question string, answer string, label string, score int, related_diseases string",
    "encyclopedia": "questions array<string>, answers array<string>",
    "graph": "questions array<string>, answers array<string>",
    "dialogue": "instruction string, input string, output string",
}


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines (malformed lines raise) or one JSON array, by extension; others are an error."""
    if path.endswith(".jsonl"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if path.endswith(".json"):
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    raise ValueError(f"no reader for {path}")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _parsed(df: DataFrame, document: Column, answer: Column, **more: Column) -> DataFrame:
    blank = {"label": "string", "score": "int", "related_diseases": "string"}
    return df.select(document.alias("document"), answer.alias("answer"), *(more.get(c, F.lit(None).cast(t)).alias(c) for c, t in blank.items()))


def _labelled(df: DataFrame) -> DataFrame:
    label = F.coalesce(T.correct_label(F.col("question"), F.col("label")), F.lit(""))
    rows = df.where(~T.is_template(F.col("question"))).where(~label.isin(*T.INVALID_LABELS))
    return _parsed(rows, _text("question"), _text("answer"), label=label, score=F.coalesce(F.col("score").cast("int"), F.lit(0)), related_diseases=_text("related_diseases"))


def _encyclopedia(df: DataFrame) -> DataFrame:
    answer = F.coalesce(F.try_element_at("answers", F.lit(1)), F.lit(""))
    return _parsed(df, T.strip(F.concat(T.first_question(F.col("questions")), F.lit(" "), answer)), answer)


def _graph(df: DataFrame) -> DataFrame:
    answer = F.array_join(F.filter("answers", lambda x: x != ""), "；")
    return _parsed(df, T.strip(F.concat(T.first_question(F.col("questions")), F.lit(" "), F.coalesce(answer, F.lit("")))), answer)


def _dialogue(df: DataFrame) -> DataFrame:
    asked = T.strip(F.concat(_text("instruction"), F.lit(" "), _text("input")))
    return _parsed(df, T.strip(F.concat(asked, F.lit(" "), _text("output"))), F.col("output"))


#: Parsers by source; more can be put in.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"labelled": _labelled, "encyclopedia": _encyclopedia, "graph": _graph, "dialogue": _dialogue}


def parse(df: DataFrame, source: str, most: int = 1500) -> DataFrame:
    """document, answer, label, score, related_diseases, source of a source's records; empty documents, templates and invalid labels go."""
    if source not in PARSERS:
        raise ValueError(f"no parser for {source}")
    return PARSERS[source](df).withColumn("document", T.truncate(F.col("document"), most)).withColumn("source", F.lit(source)).where("document <> ''")


def corpus(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' parsed records in one table."""
    return reduce(DataFrame.unionByName, [parse(df, name) for name, df in sources.items()])


def with_metadata(df: DataFrame) -> DataFrame:
    """document and metadata, the other columns as JSON without nulls."""
    return df.select("document", F.to_json(F.struct(*[c for c in df.columns if c != "document"])).alias("metadata"))
