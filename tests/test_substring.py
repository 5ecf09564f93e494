"""Substring joins against every pair of a name and a query."""

import random

import pytest

from millrace.operators import records, substring

NAMES = ["a", "ab", "abc", "abcd", " abcd", "bcd", "cd e", "éab", "漢字", "字", "x" * 40, "\U0001f600b", "AB", ""]
QUERIES = ["abcd ", "b", "bc", "zabcz", "", "  ", "漢", "一漢字二", "cd", "none", "x" * 39, "x" * 50, "\U0001f600", "ab\nabc", "A", "　abc　", "a" * 100_000 + "bcd", "a" + " " * 200_000 + "bcd", "\x1c\x85abc\u2028"]


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choices("abcdé", k=rng.randint(1, most)))
    names = NAMES + [word(7) for _ in range(400)] + ["hot" + word(6) for _ in range(300)]
    queries = QUERIES + [word(9) for _ in range(200)] + ["hot"] * 30 + ["hot" + word(2) for _ in range(60)] + [f"say {word(40)} {word(40)}" for _ in range(60)]
    return names, list(enumerate(queries))


def brute(names, queries, k):
    names, out = sorted({n for n in names if n}, key=lambda n: n.encode()), {}
    for i, raw in queries:
        q = (raw or "").strip()
        for tier, hit in ((1, lambda n: n.strip() == q), (2, lambda n: q in n), (3, lambda n: n in q)):
            found = [n for n in names if hit(n)] if q else []
            if found:
                out[i] = (tier, len(found), found[:k])
                break
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, (r.tier, r.n_hits, []))[2].append(r.name)
    return {i: (t, n, sorted(v, key=lambda x: x.encode())) for i, (t, n, v) in out.items()}


@pytest.mark.parametrize(("block", "asked", "merged", "chars"), [(1_024, 4_096, 512, 4 << 20), (5, 7, 3, 900)])
def test_lookup(spark, monkeypatch, block, asked, merged, chars):
    for name, value in (("BLOCK", block), ("ASKED", asked), ("MERGED", merged), ("SHARD_CHARS", chars)):
        monkeypatch.setattr(substring, name, value)
    names, queries = corpus()
    table = spark.createDataFrame([(n, "clash") for n in names + names[:50]] + [(None, "x")], "name string, gram string").repartition(3)
    asking = spark.createDataFrame([(i, q, "clash") for i, q in queries] + [(None, "a", ""), (9_999, None, "")], "id long, query string, name string").repartition(3)
    assert got(substring.lookup(table, asking, 4)) == brute(names, queries, 4)


def test_empty(spark):
    names, asking = spark.createDataFrame([], "name string"), spark.createDataFrame([(1, "a")], "id long, query string")
    assert substring.lookup(names, asking).collect() == []
    assert substring.lookup(spark.createDataFrame([("a",)], "name string"), asking.where("false")).collect() == []


def test_no_nested_loop(spark):
    names = spark.createDataFrame([("red ring",), ("ring",)], "name string")
    df = records.cascade_lookup(names, spark.createDataFrame([("ring",), ("red",), ("the ring",), ("ring",)], "query string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r.query, r.tier, r.name, r.n_hits) for r in df.collect()) == [("red", 2, "red ring", 1), ("ring", 1, "ring", 1), ("the ring", 3, "ring", 1)]
