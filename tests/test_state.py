"""Streams with state against their batch forms: files in any order, a stream that is killed and goes on, state that ends."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import records
from millrace.streaming import state, twins

SF = "/root/testdata/sf0.001"
KINDS = {"signup": "signup", "purchase": "approved", "error": "rejected"}
FORMS = {
    "transfers": (lambda e: state.transfers(e, "signup", "click"), lambda e: records.transfers(e, "signup", "click").select("user_id", "event_id", "n", "accepted")),
    "confirms": (lambda e: state.confirms(e, "signup", "click", idle_s=400 * 86_400), lambda e: records.token_confirms(e, "signup", "click")),
    "polls": (lambda e: state.polls(e, "signup", "view", ("purchase", "error")), lambda e: records.poll_backoff(e, "signup", "view", ("purchase", "error")).join(e.select("event_id", "user_id"), "event_id").select("user_id", "event_id", "asked")),
    "reviews": (lambda e: state.reviews(e, "signup", {"purchase": "approved", "error": "rejected"}), lambda e: records.reviews(e, "signup", {"purchase": "approved", "error": "rejected"})),
}


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.prepare(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.fixture(scope="module")
def events(spark):
    """A third of the events are one user's; times to the microsecond, some of them equal."""
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type").limit(400).collect()
    rows = [(r.event_id, rows[i - 1].ts if i % 17 == 0 and i else r.ts, 1 if i % 3 == 0 else r.user_id % 9, r.event_type) for i, r in enumerate(rows)]
    return rows


def files(spark, tmp_path, events, n=5, seed=4):
    """Events of some hours to a file, shuffled within what the watermark allows, and one far later event that ends all waiting."""
    rng, schema = random.Random(seed), "event_id long, ts timestamp, user_id long, event_type string"
    rows = sorted(events, key=lambda r: r[1])
    size = -(-len(rows) // n)
    near = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, size))
    at = f"{tmp_path}/in"
    from datetime import timedelta

    for i in range(n):
        spark.createDataFrame([rows[j] for j in near[i * size : (i + 1) * size]], schema).coalesce(1).write.mode("append").parquet(at)
    end = max(r[1] for r in rows) + timedelta(days=3_000)
    spark.createDataFrame([(-1, end, -1, "signup")], schema).coalesce(1).write.mode("append").parquet(at)
    spark.createDataFrame([(-2, end + timedelta(days=3_000), -1, "signup")], schema).coalesce(1).write.mode("append").parquet(at)
    return at, schema


def wanted(spark, form, events):
    batch = FORMS[form][1](spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string"))
    rows = batch.collect()
    # a stream tells of a pause that no event ends when it has expired
    return sorted((tuple("expired" if x == "waiting" else x for x in r) for r in rows), key=repr)


def found(spark, path):
    return sorted((tuple(r[c] for c in r.__fields__ if c != "trigger") for r in spark.read.parquet(path).where("user_id >= 0").collect()), key=repr)


@pytest.mark.parametrize("form", sorted(FORMS))
def test_any_order(spark, tmp_path, events, form):
    at, schema = files(spark, tmp_path, events)
    out = FORMS[form][0](twins.event_stream(spark, at, schema))
    state.write_once(out, f"{tmp_path}/out", f"{tmp_path}/ck").start().awaitTermination(300)
    assert found(spark, f"{tmp_path}/out") == wanted(spark, form, events)


def test_killed_and_resumed(spark, tmp_path, events):
    """Killed in the middle of a trigger, after its rows were written: it runs again, and its rows are there once."""
    at, schema = files(spark, tmp_path, events)
    out = FORMS["reviews"][0](twins.event_stream(spark, at, schema))
    seen = []

    def failing(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/trigger={number}")
        seen.append(number)
        if number == 3:
            raise RuntimeError("killed")

    query = out.writeStream.foreachBatch(failing).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination(300)
    assert seen[-1] == 3
    again = state.write_once(out, f"{tmp_path}/out", f"{tmp_path}/ck").start()
    again.awaitTermination(300)
    assert found(spark, f"{tmp_path}/out") == wanted(spark, "reviews", events)


def test_state_ends(spark, tmp_path, events):
    """No key holds anything when it has been idle."""
    at, schema = files(spark, tmp_path, events)
    out = state.confirms(twins.event_stream(spark, at, schema), "signup", "click")
    query = state.write_once(out, f"{tmp_path}/out", f"{tmp_path}/ck").start()
    query.awaitTermination(300)
    held = spark.read.format("statestore").option("path", f"{tmp_path}/ck").option("stateVarName", "held").load()
    assert {r.key.user_id for r in held.select("key").collect()} <= {-1}
    rows = {(r[0], r[1]): r[2] for r in wanted(spark, "confirms", events)}
    for user, event, outcome in found(spark, f"{tmp_path}/out"):
        assert rows[user, event] == outcome or (outcome, rows[user, event]) == ("invalid", "expired")
