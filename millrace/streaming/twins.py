"""Structured Streaming twins of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import sinks


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files of a folder (or a glob), one file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def pending_stream(events: DataFrame, opened: str, closed: tuple[str, ...]) -> DataFrame:
    """Per user: whether an item is pending, i.e. the last opening comes after the last closing; for update mode. Events may come in any order."""
    order = F.struct("ts", "event_id")
    last = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == opened, order)).alias("o"), F.max(F.when(F.col("event_type").isin(*closed), order)).alias("c"))
    return last.select("user_id", (F.col("o").isNotNull() & (F.col("c").isNull() | (F.col("c") < F.col("o")))).alias("pending"))


def audit_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events per type and hour with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def audit_sink(events: DataFrame, path: str, checkpoint: str, event: str):
    """Appends the events as audit records (JSON lines); the checkpoint makes each be written once."""
    rows = sinks.audit_records(events, event, F.col("ts"))
    return rows.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    yield from zip(rows["event_id"].tolist(), rows["event_type"].tolist(), rows["us"].tolist(), strict=True)


def _events(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return events.where(F.col("event_type").isin(*kinds)).select("user_id", "event_id", "event_type", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def transfer_cap_stream(events: DataFrame, opened: str, moved: str, most: int = 2) -> DataFrame:
    """event_id, n, accepted of each transfer of an opened item; a user's triggers must come in the order of time."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, out = state.get[0] if state.exists else -1, []
        for event, kind, _ in _in_order(batches):
            if kind == opened:
                n = 0
            elif n >= 0:
                n += 1
                out.append((event, n, n <= most))
        state.update((n,))
        yield pd.DataFrame(out, columns=["event_id", "n", "accepted"])

    return _events(events, (opened, moved)).groupBy("user_id").applyInPandasWithState(step, "event_id long, n long, accepted boolean", "n long", "append", GroupStateTimeout.NoTimeout)


def token_ttl_stream(events: DataFrame, issued: str, confirmed: str, ttl_s: int = 600) -> DataFrame:
    """event_id, outcome of each confirmation; a user's triggers must come in the order of time."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, out = state.get[0] if state.exists else -1, []
        for event, kind, us in _in_order(batches):
            if kind == issued:
                at = us
            else:
                out.append((event, "invalid" if at < 0 else "expired" if us - at > ttl_s * 1000000 else "ok"))
                at = -1
        state.update((at,))
        yield pd.DataFrame(out, columns=["event_id", "outcome"])

    return _events(events, (issued, confirmed)).groupBy("user_id").applyInPandasWithState(step, "event_id long, outcome string", "at long", "append", GroupStateTimeout.NoTimeout)
