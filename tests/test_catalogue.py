"""Each query of the catalogue against its SQL equivalent, and rules against tables derived by hand."""

import math
from pathlib import Path

import pytest

from millrace.functions import text as T
from millrace.operators import graph, records, retrieval
from millrace.plans import catalogue, indexes, workflow
from millrace.sources import readers

SF = "/root/testdata/sf0.001"


def rows(values):
    return sorted(repr(tuple(None if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x for x in r)) for r in values)


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


ORACLE = catalogue.oracle_sql() | workflow.oracle_sql() | indexes.oracle_sql()
QUERIES = catalogue.queries() | workflow.queries() | indexes.queries()
OTHERWISE = {"vector_index_search", "segment_conversations"}  # see test_vector_index, test_segment


def test_every_query_has_sql():
    assert set(ORACLE) | OTHERWISE == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_graph(spark):
    got = {(r.head, r.pred, r.tail): r.cnt for r in catalogue.kg_triples(spark, SF).collect()}
    assert len(got) == 12 and sum(got.values()) == 13 and got["多尿", "symptom_of", "糖尿病"] == 2
    nodes = {r.name: r for r in catalogue.kg_nodes(spark, SF).collect()}
    assert len(nodes) == 11 and (nodes["糖尿病"].type, nodes["糖尿病"]["count"], nodes["糖尿病"].symptom_indegree) == ("disease", 12, 2)
    tr = catalogue._kg(spark)
    best = graph.two_hop(tr, spark.createDataFrame([("多尿",)], "start string")).collect()
    assert {r.score for r in best} == {1.2909} and {r.name for r in best if r.relation == "has_drug"} == {"二甲双胍", "胰岛素"}


def test_two_hop_defaults(spark, con):
    """As many diseases and tails as there are, up to 5 and 20."""
    got = catalogue.queries()["kg_two_hop_defaults"](spark, SF).collect()
    parts = dict(con.sql("select p_brand, least(count(distinct p_name), 5) from lineitem join part on l_partkey = p_partkey group by 1").fetchall())
    tails = dict(con.sql("select p_name, least(count(distinct l_suppkey), 20) from lineitem join part on l_partkey = p_partkey group by 1").fetchall())
    found = {}
    for r in got:
        found.setdefault((r.start, r.disease), []).append(r.name)
    assert {b: sum(k[0] == b for k in found) for b in parts} == parts and max(parts.values()) > 3
    assert all(len(v) == tails[k[1]] for k, v in found.items()) and max(map(len, found.values())) > 3


def test_whole_tables(spark, con, tmp_path):
    texts = [(1, "They WANT to die"), (2, "you certainly have a cold, so said the suicide note"), (3, "fine"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.flags for r in catalogue.queries()["safety_flags_documents"](spark, f"file://{tmp_path}").collect()}
    assert got == {1: "危险信号", 2: "危险信号,诊断性表述", 3: "", 4: ""}
    n = con.sql("select count(*) from lineitem").fetchall()[0][0]
    assert {r.pred: r.instances for r in catalogue.queries()["kg_stats_star"](spark, SF).collect()} == {"symptom_of": n, "has_drug": n}
    assert sum(r["count"] for r in catalogue.queries()["kg_nodes_star"](spark, SF).collect()) == 4 * n


def test_masks(spark):
    got = {r.id: (r.masked, r.hits) for r in catalogue.pii_mask(spark, SF).collect()}
    assert got[1] == ("我是***，******，电话***", 4) and got[2] == ("中关村***", 1) and got[3] == ("113800138000", 0) and got[5] == (None, 0)


def test_vote_and_fusion(spark):
    near = [(0, i + 1, "A" if i < 12 else "B" if i < 17 else "其他") for i in range(20)]
    prior = spark.createDataFrame([("A", 3000), ("B", 300), ("rest", 6700)], "label string, prior long")
    got = [(r.label, r.score, round(r.confidence, 2)) for r in retrieval.vote(spark.createDataFrame(near, "query_id long, rank int, label string"), prior, invalid=T.INVALID_LABELS).orderBy("place").collect()]
    assert got == [("B", 41.666667, 0.63), ("A", 24.0, 0.37)]
    one = spark.createDataFrame([(0, "x", 1)], "query_id long, key string, rank long")
    two = spark.createDataFrame([(0, "x", 3)], "query_id long, key string, rank long")
    assert retrieval.fuse([one, two]).first().score == pytest.approx(1 / 61 + 1 / 63, abs=1e-8)


def test_fusion_of_all_queries(spark, con):
    want = {q for t, c in (("documents", "doc_id"), ("embeddings", "vec_id")) for (q,) in con.sql(f"select {c} from {t} where {c} % 100 = 0").fetchall()}
    assert len(want) > 1 and {r.query_id for r in catalogue.queries()["rrf_fusion_queries"](spark, SF).collect()} == want


@pytest.mark.parametrize(("often", "block"), [(0.02, 4000), (0.3, 2), (2.0, 4000)])
def test_bm25_queries(spark, monkeypatch, often, block):
    monkeypatch.setattr(retrieval, "OFTEN", often)
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", block)
    texts = [(i, " ".join(f"w{(i * j * 7 + j) % 23}" for j in range(i % 13))) for i in range(40)] + [(40, None), (41, "W1 w1 w1 nowhere")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = [7, 11, 12, 13, 40, 41]
    got = {}
    for r in retrieval.bm25_queries(docs, docs.where(docs.doc_id.isin(asked)).selectExpr("doc_id as query_id", "text"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score, 5)))
    for q in asked:
        one = [(r.doc_id, round(r.score, 5)) for r in retrieval.bm25_search(docs, (texts[q][1] or "").lower().split(), k=6).orderBy("rank").collect()] if texts[q][1] else []
        assert sorted(got.get(q, [])) == [(i + 1, *x) for i, x in enumerate([x for x in one if x[0] != q][:5])]


def test_sampling_and_lookup(spark):
    seven = spark.createDataFrame([(i, "a") for i in range(1, 8)], "seq long, label string")
    assert sorted(r.seq for r in records.balanced_sample(seven, "label", "seq", 3).collect()) == [3, 5, 7]
    names = spark.createDataFrame([("阿司匹林",), ("阿司匹林栓",)], "name string")
    asked = spark.createDataFrame([("阿司匹林",), ("阿司",), ("孕妇能吃阿司匹林吗",), (" ",)], "query string")
    got = {}
    for r in records.cascade_lookup(names, asked).collect():
        got.setdefault(r["query"], []).append(r["name"])
    assert {k: sorted(v) for k, v in got.items()} == {"阿司匹林": ["阿司匹林"], "阿司": ["阿司匹林", "阿司匹林栓"], "孕妇能吃阿司匹林吗": ["阿司匹林"]}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"questions": [["q1", "q2"]], "answers": ["a"]}\n\n{"questions": [], "answers": []}\n')
    df = readers.read(spark, f"file://{tmp_path}/a.jsonl", readers.SCHEMAS["encyclopedia"])
    assert [r.document for r in readers.parse(df, "encyclopedia").collect()] == ["q1 a"]
    with pytest.raises(ValueError):
        readers.read(spark, "a.csv", "x int")


def test_stream(spark, tmp_path):
    from millrace.streaming import twins

    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = twins.pending_stream(twins.event_stream(spark, f"file://{tmp_path}/in", batch.schema), "signup", ("purchase", "error"))
    last = {}

    def take(df, _):
        last.update({r.user_id: r.pending for r in df.collect()})

    stream.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).foreachBatch(take).start().awaitTermination(120)
    assert {u for u, p in last.items() if p} == {r.user_id for r in records.pending_queue(batch, "signup", ("purchase", "error")).collect()}


def test_bm25_queries_read_documents_once(spark, monkeypatch):
    """However many blocks the queries make."""
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 3)
    seen = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(i, f"a{i % 5} b{i % 3} c{i} both") for i in range(60)], "doc_id long, text string")

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    asked = spark.createDataFrame([(1_000 + i, f"a{i % 5} c{i}") for i in range(10)], "query_id long, text string")
    got = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.bm25_queries(docs.mapInArrow(passed, docs.schema), asked, k=3).collect()}
    assert seen.value == 60 and len(got) == 30 and all(got[1_000 + i, 1] == i for i in range(10))


def test_bm25_queries_read_queries_once(spark, monkeypatch):
    """Besides counting them, and however many blocks they make: each block used to read all documents for its queries."""
    monkeypatch.setattr(retrieval, "TEXT_BLOCK", 3)
    seen = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(i, f"a{i % 5} c{i} both") for i in range(60)], "doc_id long, text string")

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    asked = spark.createDataFrame([(1_000 + i, f"a{i % 5} c{i}") for i in range(10)], "query_id long, text string").mapInArrow(passed, "query_id long, text string")
    got = {(r.query_id, r["rank"]): r.doc_id for r in retrieval.bm25_queries(docs, asked, k=3).collect()}
    assert seen.value <= 20 and len(got) == 30 and all(got[1_000 + i, 1] == i for i in range(10))


@pytest.mark.parametrize("shared_words", [0, 25])
def test_bm25_queries_of_kinds(spark, monkeypatch, shared_words):
    """Texts of three kinds, copies among them, more than one product holds, against all sums; words of all texts weigh less than nothing where nearly all are such."""
    import random
    from collections import Counter

    monkeypatch.setattr(retrieval, "TILE", 7)
    r = random.Random(5)
    common = [f"all{i}" for i in range(shared_words)]
    texts = [common + [f"{'xyz'[i % 3]}{int(40 * r.random() ** 3)}" for _ in range(0 if shared_words else r.randint(0, 40))] for i in range(1_400)]
    texts[1_200:1_300] = texts[:100]
    rare = Counter(w for t in texts for w in set(t))
    n, raw = len(texts), {w: math.log(len(texts) - c + 0.5) - math.log(c + 0.5) for w, c in rare.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    avgdl, counts = sum(map(len, texts)) / n, [Counter(t) for t in texts]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    got = {}
    for x in retrieval.bm25_queries(docs, docs.where("doc_id % 70 = 0").selectExpr("doc_id as query_id", "text"), k=5).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.doc_id, round(x.score, 5)))
    for q in range(0, n, 70):
        score = lambda d: sum(f * idf[w] * counts[d][w] * 2.5 / (counts[d][w] + 1.5 * (0.25 + 0.75 * len(texts[d]) / avgdl)) for w, f in counts[q].items() if w in counts[d])  # noqa: B023, E731
        best = sorted((-round(score(d), 6), d) for d in range(n) if d != q)[:5]
        assert sorted(got.get(q, [])) == [(i + 1, d, round(-s, 5)) for i, (s, d) in enumerate(best) if s < 0]


def test_words_of_batches(spark):
    """The same words as by the expression, of odd texts too."""
    from pyspark.sql import functions as F

    from millrace.operators import plug

    texts = [None, "", " - ", "a", "A b  a.B", "Kelvin İx 9é9", "äb", "end", "end", "\n", "z" * 5_000, "0　1 0"] + [" ".join(f"w{i * j % 7}" for j in range(i % 9)) for i in range(1_500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    terms = {}
    for r in retrieval._terms(retrieval._counts(docs)).collect():
        terms.setdefault(r.doc_id, {})[r.tok] = r.tf
    size = {r.doc_id: r.dl for r in retrieval._counts(docs).collect()}
    for r in docs.select("doc_id", plug.latin_tokens(F.col("text")).alias("t")).collect():
        assert size[r.doc_id] == (None if r.t is None else len(r.t)) and terms.get(r.doc_id, {}) == {w: r.t.count(w) for w in r.t or []}
