"""A keyed table against a replay in a dictionary, and a graph that grows against the whole one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, graph_state
from millrace.plans import catalogue
from millrace.sources.keyed import KeyedTable

SCHEMA = "k string, at long, v string"


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_replay(spark, tmp_path):
    rng, path = random.Random(5), f"file://{tmp_path}/t"
    log = [(rng.choice([None, "", "hot", "hot", "hot", *map(str, range(40))]), i, f"v{i}", rng.random() < 0.2) for i in range(600)]
    rng.shuffle(log)
    for n, at in enumerate(range(0, 600, 150)):
        rows = spark.createDataFrame([(*r, "clash") for r in log[at:at + 150]], f"{SCHEMA}, deleted boolean, bucket string").repartition(3)
        table = KeyedTable(spark, path, SCHEMA, ["k"], ["at"], buckets=8)  # opened anew for each, as after a restart
        assert table.upsert(rows, n) and not table.upsert(rows, n)
    last = {}
    for k, at, v, gone in sorted(log, key=lambda r: r[1]):
        last[k] = (k, at, v, gone)
    want = {r[:3] for r in last.values() if not r[3]}
    assert {tuple(r) for r in table.read().collect()} == want and table.read().count() == len(want)
    assert table.compact(3) and {tuple(r) for r in table.read().collect()} == want and table.compact(3) == []
    assert all(len(p) == 1 for p in table.parts().values())
    assert table.batch() == 3 and not table.upsert(rows, 3)


def test_untouched_buckets_stay(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=8)
    table.upsert(spark.createDataFrame([(str(i), 0, "a") for i in range(80)], SCHEMA))
    before, parts = files(tmp_path), table.parts()
    for at in (1, 2):
        table.upsert(spark.createDataFrame([("7", at, "b")], SCHEMA))
    touched = table.compact(1)
    assert len(touched) == 1
    assert {b: p for b, p in table.parts().items() if b not in touched} == {b: p for b, p in parts.items() if b not in touched}
    assert all(files(tmp_path)[f] == t for f, t in before.items())  # nothing that was there is written again
    new = {f for f in files(tmp_path) if f not in before and "/parts/" in f}
    assert all(f"bucket={touched[0]}/" in f for f in new)
    assert len(table.sweep()) == 2 and table.read().count() == 80 and table.read().where("k = '7'").first().v == "b"


def test_killed_writer_and_edges(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=4)
    assert table.read().collect() == [] and table.compact() == []
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, None)], SCHEMA)
    table.upsert(rows.where("false"))
    assert table.read().collect() == [] and table.parts() == {}
    table.upsert(rows)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1, "y")]
    # a writer that was killed after its part, and one within its version
    table._write(table._folded(rows.withColumn("v", F.lit("z")).withColumn("deleted", F.lit(False))))
    os.makedirs(f"{tmp_path}/t/versions/9")
    assert [tuple(r) for r in table.read().collect()] == [("a", 1, "y")]
    table.upsert(spark.createDataFrame([("a", 2, "w")], SCHEMA))
    assert [tuple(r) for r in KeyedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], ["at"], buckets=99).read().collect()] == [("a", 2, "w")]
    for wrong in ({}, {"order": ["at"], "merged": {"v": F.max}}, {"merged": {"v": F.max}}):
        with pytest.raises(ValueError):
            KeyedTable(spark, f"file://{tmp_path}/u", SCHEMA, ["k"], **wrong)


@pytest.mark.parametrize("cut", [1, 4, 7])
def test_graph_grows(spark, tmp_path, cut):
    """Seeds that come after their triples, and symptoms that count backwards, as in the whole."""
    records = spark.createDataFrame(catalogue.KG_ROWS, "seq long, question string, answer string")
    state = graph_state.GraphState(spark, f"file://{tmp_path}/g", buckets=4)
    late, early = records.where(f"seq >= {cut}"), records.where(f"seq < {cut}")
    assert state.add(late, 1) and state.add(early, 2) and not state.add(early, 2)
    want = sorted(map(tuple, graph.triples(records).collect()))
    assert sorted(map(tuple, state.triples().collect())) == want and want
    state.compact(1)
    assert sorted(map(tuple, state.triples().collect())) == want
    assert sorted(map(tuple, state.nodes().collect())) == sorted(map(tuple, graph.nodes(graph.triples(records)).collect()))


def test_records_are_counted_once(spark, tmp_path, monkeypatch):
    """Rules see equal records once, whatever the records come from is worked out once, and a compacted table is not folded again."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, f"m{i % 7}的推荐药", f"s{i % 3}") for i in range(2_000)] + [(-i, f"m{i}的就诊科室", "d1") for i in range(1, 5)]
    records = spark.createDataFrame(rows, "seq long, question string, answer string").repartition(4)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    asked, real = [], graph.instances
    monkeypatch.setattr(graph, "instances", lambda r: (asked.append(r), real(r))[1])
    state = graph_state.GraphState(spark, f"file://{tmp_path}/g", buckets=4)
    state.add(records.mapInArrow(passed, records.schema), 1)
    assert seen.value == len(rows) and asked[0].count() == 25
    state.add(spark.createDataFrame(rows[:10], records.schema), 2)
    # twice in the graph: added twice
    want = sorted(map(tuple, graph.triples(records.unionByName(spark.createDataFrame(rows[:10], records.schema))).collect()))
    assert sorted(map(tuple, state.triples().collect())) == want and len(want) == 12 + 4
    state.compact(1)
    assert sorted(map(tuple, state.triples().collect())) == want
    assert "Exchange" not in state.instances.read()._jdf.queryExecution().executedPlan().toString()
