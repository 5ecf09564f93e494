"""Nearest neighbours against a plain loop over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import retrieval

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k, filter_label):
    out = []
    fits = lambda x: x is not None and len(x) == 3 and all(e is not None and math.isfinite(e) for e in x)
    for i, q, want in asked:
        if i is None or not fits(q):
            continue
        near = [(round(sum((float(np.float32(a)) - float(np.float32(b))) ** 2 for a, b in zip(v, q)), 9), j, lab) for j, v, lab in rows if j is not None and j != i and fits(v) and (not filter_label or (want is not None and lab == want))]
        out += [(i, want if filter_label else None, j, lab, d, r + 1) for r, (d, j, lab) in enumerate(sorted(near, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("filter_label", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_knn(spark, monkeypatch, filter_label, small):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3) * 0.5], int(i % 4)) for i in range(300)]
    rows += [(300 + i, [1.0, 1.0, 1.0], 1) for i in range(150)]  # a third are copies
    rows += [(900, [1000.0, 1e-3, 0.0], None), (901, [1000.0, 1.1e-3, 0.0], None), (902, None, 1), (903, [1.0, None, 1.0], 1), (904, [1.0], 1), (905, [float("nan"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (906, [], 2)]
    asked = [(i, v, lab) for i, v, lab in rows if i is None or i % 7 == 0 or i >= 900] + [(7, [0.5, 0.5, 0.5], 3), (5000, [0.0, 0.0, 0.0], 77)]
    asked = [a for n, a in enumerate(asked) if n == len(asked) - 2 or a[0] != 7]
    if small:
        monkeypatch.setattr(retrieval, "QUERY_BYTES", 700)
        monkeypatch.setattr(retrieval, "TILE", 16)
        monkeypatch.setattr(retrieval, "ROWS", 32)
    corpus = spark.createDataFrame(rows, ROWS).repartition(3).withColumn("dist", F.lit("a clashing name"))
    queries = spark.createDataFrame(asked, "query_id long, query array<float>, query_label int")
    got = retrieval.knn(corpus, queries if filter_label else queries.drop("query_label"), 5, filter_label).collect()
    got = sorted(((r.query_id, r.query_label if filter_label else None, r.vec_id, r.label, r.dist, r["rank"]) for r in got), key=repr)
    assert got == brute(rows, asked, 5, filter_label)


def test_knn_empty(spark):
    none = spark.createDataFrame([], "query_id long, query array<float>")
    rows = spark.createDataFrame([(1, [1.0], 1)], ROWS)
    assert retrieval.knn(rows, none, 3).count() == 0
    asked = spark.createDataFrame([(1, [1.0]), (2, [0.0])], none.schema)
    assert retrieval.knn(rows.limit(0), asked, 3).count() == 0
    assert [(r.query_id, r.vec_id) for r in retrieval.knn(rows, asked, 3).collect()] == [(2, 1)]
