"""Places where models go in: embedding, reranking, auditing, tokenising. The defaults are deterministic stand-ins without quality claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def hashed_embedding(text: Column, dim: int = 64, tokens: Callable[[Column], Column] = latin_tokens) -> Column:
    """Counts of hashed tokens over ``dim`` places, scaled to length 1 (zeros without tokens)."""
    places = F.transform(F.coalesce(tokens(text), F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def overlap(query: Column, document: Column, tokens: Callable[[Column], Column] = latin_tokens) -> Column:
    """The share of the query's distinct tokens that the document has."""
    q = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(q, tokens(document))) / F.greatest(F.size(q), F.lit(1))


def rerank(candidates: DataFrame, top: int, score: Callable[[Column, Column], Column] = overlap, enabled: bool = True) -> DataFrame:
    """The ``top`` best of each query's candidates (query_id, query, key, text, rank): by score where there are
    more than ``top`` and it is enabled, else as they stand."""
    by_query = Window.partitionBy("query_id")
    many = (F.count("*").over(by_query) > top) & F.lit(enabled)
    scored = candidates.withColumn("score", F.when(many, score(F.col("query"), F.col("text"))))
    place = F.row_number().over(by_query.orderBy(F.desc_nulls_last("score"), "rank"))
    return scored.withColumn("place", place.cast("long")).where(F.col("place") <= top)


def audit(samples: DataFrame, judge: Callable[[DataFrame], Column]) -> DataFrame:
    """The samples with approved, as a rule or model column judges them; a null is an error."""
    verdict = judge(samples)
    return samples.withColumn("approved", verdict).withColumn("error", F.col("approved").isNull())
