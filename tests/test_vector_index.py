"""The inverted lists against a search of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval, vector_index

ROWS = "vec_id long, embedding array<float>, label int"


def vectors(n=1_500, dim=6):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(25, dim)) * 3
    rows = [(i, [float(x) for x in centres[i % 25] + rng.normal(size=dim)], int(i % 5)) for i in range(n)]
    rows += [(10_000 + i, [1.0] * dim, None) for i in range(n // 2)]  # a third are copies
    return rows + [(20_000, None, 1), (20_001, [1.0, None, *[0.0] * (dim - 2)], 1), (20_002, [float("nan")] * dim, 1), (20_003, [1.0], 1), (None, [1.0] * dim, 1), (20_004, [1e6] * dim, 1)]


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.label, r.dist) for r in df.collect())


@pytest.mark.parametrize(("block", "queries", "lists"), [(4_096, 256, None), (50, 7, 12), (3, 2, 1)])
def test_exact(spark, tmp_path, monkeypatch, block, queries, lists):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    monkeypatch.setattr(vector_index, "QUERIES", queries)
    rows = spark.createDataFrame(vectors(600), ROWS).repartition(3)
    asked = rows.where("vec_id % 20 = 0 or vec_id >= 20000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector_index.VectorIndex.build(rows, f"{tmp_path}/index", lists)
    assert sum(len(r.ids) for r in index.blocks.collect()) == 901  # every row that has a distance
    assert max(len(r.ids) for r in index.blocks.collect()) <= block
    assert got(index.search(asked, 9, probes=2, exact=True)) == got(retrieval.knn(rows, asked, 9))


def test_recall_and_pruning(spark, tmp_path):
    rows = spark.createDataFrame(vectors(), ROWS)
    index = vector_index.VectorIndex.build_or_load(rows, f"{tmp_path}/index")
    assert len(index.centres) == int(2_256**0.5) and vector_index.VectorIndex.build_or_load(rows.limit(0), f"{tmp_path}/index").radius.tolist() == index.radius.tolist()
    asked = rows.where("vec_id % 50 = 0 and vec_id < 10000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = index.search(asked, 10, probes=8)
    assert 1 <= index.probes <= len(index.centres)
    shares = [r.recall for r in vector_index.recall(found, retrieval.knn(rows, asked, 10)).collect()]
    assert len(shares) == 30 and sum(shares) / len(shares) >= 0.9
    near = index._near(index._pairs(asked.limit(1).withColumn("least", F.lit(None)), 0, 2), 10)
    plan = near._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(s for s in plan.split("\n\n") if "/blocks" in s and "Scan parquet" in s)
    assert "list" in scan.split("PartitionFilters")[1].splitlines()[0]


def test_queries_of_lists_are_not_broadcast(spark, tmp_path):
    """Every query at every list is too much for the driver, however small its files are."""
    index = vector_index.VectorIndex.build(spark.createDataFrame(vectors(), ROWS), f"{tmp_path}/index")
    asked = index.blocks.select(F.explode("ids").alias("query_id")).select("query_id", F.array(*[F.lit(1.0)] * 6).alias("query"), F.lit(None).alias("least"))
    near = index._near(index._pairs(asked, 0, len(index.centres)), 10)
    assert near.count() > 0
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_given_vectors(spark, tmp_path, sf):
    """At production parameters."""
    rows = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = vector_index.VectorIndex.build(rows, f"{tmp_path}/index").search(asked, 20)
    shares = [r.recall for r in vector_index.recall(found, retrieval.knn(rows, asked, 20)).collect()]
    assert sum(shares) / len(shares) >= 0.9


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    index = vector_index.VectorIndex.build(none, f"{tmp_path}/index")
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>"), 3, exact=True).collect() == []
