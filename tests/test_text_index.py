"""The block-max index against a full scan."""

import math
import random
from collections import Counter

import pytest

from millrace.operators import retrieval, text_index

DOCS = "doc_id long, text string"


def corpus(n=3_000, seed=7):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4_000)]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randint(10, 40))) + (" rare" if i % 75 == 2 else "")) for i in range(n)]
    rows[n // 6] = (n // 6 * 3, " ".join(["w1"] * 30 + ["w2"] * 5))
    return rows + [(9_000_001, None), (9_000_002, ""), (9_000_003, "?!"), (9_000_005, rows[9][1]), ((1 << 63) - 2, rows[10][1])]


def brute(rows, text, k):
    docs = {i: (t or "").split() if (t or "").strip("?!") else [] for i, t in rows}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    out = []
    for i, d in docs.items():
        tf = Counter(d)
        found = [t for t in text.split() if t in tf]
        if found:
            out.append((round(sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in found), 6), i))
    return [(i, s) for s, i in sorted(out, key=lambda x: (-x[0], x[1]))[:k] if s > 0]


QUERIES = ["rare", "w1 w2 rare", "w1", "w3 w3 w9 w17", "w1 w2 w3 w4 w5 w6", "nothing", "", "w1 w900 w40"]


@pytest.mark.parametrize(("block", "docs", "tokens"), [(8, 500, 1 << 20), (128, 65_536, 8 << 20), (2, 10_000, 3_000)])
def test_search(spark, tmp_path, monkeypatch, block, docs, tokens):
    monkeypatch.setattr(text_index, "BLOCK", block)
    monkeypatch.setattr(text_index, "SHARD_DOCS", docs)
    monkeypatch.setattr(text_index, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(text_index, "QUERIES", 3 if block < 128 else 256)
    rows = corpus()
    index = text_index.TextIndex.build(spark.createDataFrame(rows, DOCS).repartition(3), f"{tmp_path}/index")
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, text string")
    got = {}
    for r in sorted(index.search(asked, 10).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i, q in enumerate(QUERIES):
        assert got.get(i, []) == brute(rows, q, 10)
    skipped = {r.query_id: (r.blocks, r.read) for r in index.skipped(asked, 10).collect()}
    assert all(read <= blocks for blocks, read in skipped.values()) and 5 not in skipped
    if block < 128:  # a rare word lets most blocks of frequent ones be skipped
        assert skipped[1][1] < 0.8 * skipped[1][0] and skipped[2][1] < 0.1 * skipped[2][0], skipped


def test_statistics_and_pruning(spark, tmp_path):
    rows = corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    index = text_index.TextIndex.build_or_load(docs, f"{tmp_path}/index")
    as_rows = lambda df: sorted((r.tok, r.df, round(r.idf, 9)) for r in df.collect())
    assert as_rows(index.stats()) == as_rows(retrieval.bm25_stats(docs)[0])
    again = text_index.TextIndex.build_or_load(docs.limit(0), f"{tmp_path}/index")
    assert again.size == index.size and again.stats().count() == index.stats().count()
    asked = spark.createDataFrame([(1, "rare w7")], "query_id int, text string")
    plan = index.heads(asked)[0]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = next(s for s in plan.split("\n\n") if "/blocks" in s and "Scan parquet" in s)
    assert "bucket" in scan.split("PartitionFilters")[1].splitlines()[0] and "In(tok" in scan and "doc_ids" not in scan.split("ReadSchema")[1]


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    index = text_index.TextIndex.build(none, f"{tmp_path}/index")
    assert index.search(spark.createDataFrame([(1, "a b")], "query_id int, text string")).collect() == []
    assert index.search(spark.createDataFrame([], "query_id int, text string")).collect() == []


def test_memory_of_a_shard(monkeypatch):
    """A shard's words are counted as they come: what is held at once is far less than its tokens."""
    import numpy as np
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c()), "partitionId": lambda self: 0}))
    rng, words = np.random.default_rng(1), np.array([f"word{i}" for i in range(5_000)], object)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(1_025) * 400, pa.int32()), pa.array(words[np.minimum(rng.zipf(1.3, 1_024 * 400) - 1, 4_999)], pa.string()))

    def batches(n):
        for i in range(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1_024)[::-1] + i * 1_024), pa.concat_arrays([lists])], names=["doc_id", "tokens"])

    most, seen = [0], batches(20)

    def watched():
        for b in seen:
            most[0] = max(most[0], pa.total_allocated_bytes())
            yield b

    before = pa.total_allocated_bytes()
    blocks = pa.Table.from_batches(text_index._shards(watched(), 128, 1 << 20, 1 << 30))
    assert most[0] - before < 4 * lists.nbytes  # of 20 batches
    assert sum(len(x) for x in blocks["doc_ids"].to_pylist()) == 20 * sum(len(set(x)) for x in lists.to_pylist())
    assert sum(sum(x) for x in blocks["tfs"].to_pylist()) == 20 * 1_024 * 400
    assert all(x == sorted(x) and (x[0], x[-1]) == (lo, hi) for x, lo, hi in zip(*(blocks[c].to_pylist() for c in ("doc_ids", "lo", "hi")), strict=True))


def test_a_shard_without_words(spark, tmp_path):
    index = text_index.TextIndex.build(spark.createDataFrame([(1, ""), (2, None)], DOCS).coalesce(1), f"{tmp_path}/index")
    assert index.size["n"] == 2 and index.search(spark.createDataFrame([(1, "a")], "query_id int, text string")).collect() == []
