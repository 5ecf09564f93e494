"""Names resolved by bounded cosine search, against every pair."""

import random

import numpy as np

from millrace.operators import graph, vector_index

ROWS = "query string, vector array<float>"


def vectors(seed=5, n=600, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    points = [centres[i % 12] + 0.15 * rng.normal(size=dim) for i in range(n)]
    rows = [(f"n{i}", [float(x) for x in p.astype(np.float32)]) for i, p in enumerate(points)]
    rows += [(f"copy{i}", rows[5][1]) for i in range(200)] + [("twice", [2 * x for x in rows[9][1]]), ("twice", rows[7][1])]  # a hot vector; scaled; two vectors of one name
    return rows + [("zero", [0.0] * dim), ("null", None), ("hole", [None] * dim), ("nan", [float("nan")] * dim), ("short", [1.0])]


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    x, y = np.array(a), np.array(b)
    norm = np.sqrt(x @ x) * np.sqrt(y @ y)
    return round(float(x @ y / norm), 6) if 0 < norm < np.inf else None


def brute(asked, nodes, least):
    names, out = {n for n, _ in nodes}, {}
    for q, v in asked:
        if q in names:
            out[q] = (q, "exact", None)
            continue
        sims = [(-s, n) for n, w in nodes if (s := cosine(v, w)) is not None]
        best = min(sims, default=(2, None))
        out[q] = (best[1], "nearest", -best[0]) if -best[0] >= least else (None, None, None)
    return out


def test_resolve(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    rows = vectors()
    rng = random.Random(1)
    asked = [(f"q{i}", rows[i * 7][1]) for i in range(40)] + [("n3", rows[0][1]), ("hot", rows[5][1]), ("scaled", rows[9][1])]
    asked += [(f"far{i}", [rng.uniform(-1, 1) for _ in range(12)]) for i in range(40)] + [("qzero", [0.0] * 12), ("qnull", None), ("qshort", [1.0])]
    nodes = spark.createDataFrame(rows, "name string, vector array<float>").repartition(3)
    for least in (0.6, 0.95):
        got = graph.resolve(spark.createDataFrame(asked, ROWS).repartition(3), nodes.select("name"), nodes, least, {})
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
        assert {r["query"]: (r.node, r.method, r.sim) for r in got.collect()} == {**brute([a for a in asked if a[0] != "qshort"], rows, least), "qshort": (None, None, None)}


def test_lists_are_excluded(spark, tmp_path):
    rows = [(i, [float(x / np.linalg.norm(v)) for x in v], n) for i, (n, v) in enumerate(vectors()[:600])]
    index = vector_index.VectorIndex.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), f"file://{tmp_path}/index")
    asked = spark.createDataFrame([(-1 - i, rows[i][1]) for i in range(50)], "query_id long, query array<double>")
    met = [r.lists for r in index.met(asked, 0.1).collect()]
    assert len(met) == 50 and sum(met) < 0.5 * 50 * len(index.centres), (sum(met), len(index.centres))


def test_empty(spark):
    nodes = spark.createDataFrame([], "name string, vector array<float>")
    assert [tuple(r) for r in graph.resolve(spark.createDataFrame([("a", [1.0])], ROWS), nodes.select("name"), nodes, aliases={}).collect()] == [("a", None, None, None)]
    assert graph.resolve(spark.createDataFrame([], ROWS), nodes.select("name"), nodes, aliases={}).collect() == []
