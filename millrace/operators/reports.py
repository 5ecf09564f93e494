"""Reports on corpora, labels, judges and extractions. Each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judge_summary(cases: DataFrame) -> DataFrame:
    """Of (hit, rank, quality, error): n without errors, hit rate, first-place rate, mean quality, mean rank of hits."""
    ok = cases.where(F.col("error").isNull())
    hit = F.coalesce(F.col("hit"), F.lit(False))
    mean = lambda c, n: F.bround(F.avg(c.cast("double")), n)
    return ok.agg(
        F.count("*").alias("n"), mean(hit.cast("int"), 4).alias("hit_rate"), mean(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("int"), 4).alias("top1_rate"),
        mean(F.col("quality"), 3).alias("mean_quality"), F.coalesce(mean(F.when(hit, F.col("rank")), 3), F.lit(0.0)).alias("mean_rank"),
    )


def cleaning_report(rows: DataFrame, label: Column, template: Column, corrected: Column) -> DataFrame:
    """label, scanned, template_filtered, corrected: a template counts as filtered only, whatever its label would become."""
    t = F.coalesce(template, F.lit(False))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("scanned"), F.count_if(t).alias("template_filtered"), F.count_if(~t & ~corrected.eqNullSafe(label)).alias("corrected"))


def audit_report(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Of samples (id) and verdicts (id, approved, error): counts, and the share approved of all audited, errors included."""
    both = samples.join(verdicts, "id", "left")
    bad = F.coalesce(F.col("error"), F.col("approved").isNull())
    yes = ~bad & F.col("approved")
    out = both.agg(F.count("*").alias("audited"), F.count_if(yes).alias("approved"), F.count_if(~bad & ~F.col("approved")).alias("rejected"), F.count_if(bad).alias("error"))
    return out.withColumn("approve_rate", F.when(F.col("audited") > 0, F.bround(F.col("approved") / F.col("audited"), 3)))


def extraction_stats(rows: DataFrame) -> DataFrame:
    """Of (items, error): candidates, ok, failed, empty, mean number of items of those that succeeded."""
    fine = F.col("error").isNull()
    n = F.coalesce(F.size("items"), F.lit(0))
    return rows.agg(
        F.count("*").alias("candidates"), F.count_if(fine).alias("ok"), F.count_if(~fine).alias("failed"), F.count_if(fine & (n <= 0)).alias("empty"),
        F.coalesce(F.bround(F.avg(F.when(fine, F.greatest(n, F.lit(0)).cast("double"))), 2), F.lit(0.0)).alias("mean_items"),
    )


def match_rate(found: DataFrame) -> DataFrame:
    """Of (found, acceptable, first): how many cases found something acceptable, and how many led to a result."""
    hit = F.coalesce(F.array_contains("acceptable", F.col("found")), F.lit(False))
    return found.agg(F.count("*").alias("cases"), F.count_if(hit).alias("hits"), F.count_if(F.coalesce(F.col("first"), F.lit("")) != "").alias("answered"))


def all_up(balance: DataFrame) -> DataFrame:
    """Whether every label of the baseline is above it, of ``records.label_balance``."""
    return balance.where("base is not null").agg(F.coalesce(F.bool_and(F.col("cnt") > F.col("base")), F.lit(True)).alias("all_up"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows (an operator whose purpose is the limit) in an order that key and seed fix."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of equal keys."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")
