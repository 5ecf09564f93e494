"""Streams with state per key that go by event time: order by watermark, expiry by timers, and restarts.

A key's events wait in a buffer of its state until the watermark has passed them; then they are folded
in the order of time, whatever order the files came in. Events that come later than the watermark
are dropped by Spark. What a key holds ends when it has been idle for ``idle_s``. A stream that was
killed goes on from its checkpoint; ``write_once`` overwrites a trigger's own folder, so that a
trigger that runs twice leaves its rows once.

The steps below are those of ``operators.records``, whose batch forms give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Named by the class, as state lists, timers and expiry need it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Set the state store that these streams need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Folds a key's events (event_id, event_type, us) in the order of time.

    ``step(state, event_id, kind, us)`` gives the new state, a tuple of the fields of ``schema`` (None: nothing is held),
    and output rows; ``ended(state, us)`` gives output rows of a state that the watermark ``us`` may have ended, and what is left of it.
    ``wakes(state)`` is the time at which to look at it again, if any.
    """

    def __init__(self, schema: str, step: Callable, idle_s: int, ended: Callable | None = None, wakes: Callable | None = None):
        self.schema, self.step, self.idle, self.ended, self.wakes = schema, step, idle_s * 1_000_000, ended, wakes

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "event_id long, kind string, us long")
        self.held = handle.getValueState("held", f"{self.schema}, last_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.event_id, r.event_type, r.us) for r in rows]
        self.buffer.appendList(new)
        self.handle.registerTimer(min(us for _, _, us in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.buffer.get()]
        ready, out = sorted((x for x in waiting if x[2] <= now), key=lambda x: (x[2], x[0])), []
        state = tuple(self.held.get()) if self.held.exists() else None
        state, last = (state[:-1], state[-1]) if state else (None, 0)
        for event, kind, us in ready:
            state, rows = self._ended(state, us - 1)
            out += rows
            state, rows = self.step(state, event, kind, us)
            out, last = out + rows, us
        rest = [x for x in waiting if x[2] > now]
        state, rows = self._ended(state, min([now, *(x[2] - 1 for x in rest)]))
        out += rows
        if ready:
            self.buffer.put(rest) if rest else self.buffer.clear()
        if rest:
            self.handle.registerTimer(min(x[2] for x in rest) // 1000 + 1)
        if state is None or (last + self.idle <= now and not rest):
            if self.held.exists():
                self.held.clear()
        else:
            self.held.update((*state, last))
            at = [last + self.idle, *([w] if self.wakes and (w := self.wakes(state)) is not None else [])]
            self.handle.registerTimer(max(min(at), now + 1) // 1000 + 1)
        return (Row(user_id=key[0], **row) for row in out)

    def _ended(self, state, us: int):
        return self.ended(state, us) if self.ended and state is not None else (state, [])

    def close(self) -> None:
        pass


def folded(events: DataFrame, processor: InOrder, kinds: tuple[str, ...], output: str, late: str) -> DataFrame:
    """The rows of ``processor`` over a stream of events (user_id, event_id, event_type, ts) of the given kinds; events may be ``late``."""
    rows = events.where(F.col("event_type").isin(*kinds) & F.col("user_id").isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("us"))
    key = dict(rows.dtypes)["user_id"]
    return rows.groupBy("user_id").transformWithState(statefulProcessor=processor, outputStructType=f"user_id {key}, {output}", outputMode="Append", timeMode="EventTime")


def transfers(events: DataFrame, opened: str, moved: str, most: int = 2, late: str = "1 day", idle_s: int = 30 * 86_400) -> DataFrame:
    """event_id, n, accepted of each transfer of an opened item (``records.transfers``)."""

    def step(state, event, kind, us):
        if kind == opened:
            return (0,), []
        if state is None:
            return None, []
        n = state[0] + 1
        return (n,), [{"event_id": event, "n": n, "accepted": n <= most}]

    return folded(events, InOrder("n long", step, idle_s), (opened, moved), "event_id long, n long, accepted boolean", late)


def confirms(events: DataFrame, issued: str, confirmed: str, ttl_s: int = 600, late: str = "1 day", idle_s: int | None = None) -> DataFrame:
    """event_id, outcome of each confirmation (``records.token_confirms``). A token is dropped when it has been expired for as long
    as it was valid, and a confirmation after that is told that it is invalid, unless ``idle_s`` says how long to keep it."""

    def step(state, event, kind, us):
        if kind == issued:
            return (us,), []
        if state is None:
            return None, [{"event_id": event, "outcome": "invalid"}]
        return None, [{"event_id": event, "outcome": "expired" if us - state[0] > ttl_s * 1_000_000 else "ok"}]

    return folded(events, InOrder("issued_us long", step, 2 * ttl_s if idle_s is None else idle_s), (issued, confirmed), "event_id long, outcome string", late)


def polls(events: DataFrame, opened: str, polled: str, closed: tuple[str, ...], fast_s: int = 3, slow_s: int = 20, window_s: int = 180, late: str = "1 day", idle_s: int = 30 * 86_400) -> DataFrame:
    """event_id, asked of each poll while an item waits (``records.poll_backoff``)."""

    def step(state, event, kind, us):
        if kind == opened:
            return (us, None), []
        if kind in closed or state is None:
            return None, []
        began, last = state
        asked = last is None or us - last >= (fast_s if us - began < window_s * 1_000_000 else slow_s) * 1_000_000
        return (began, us if asked else last), [{"event_id": event, "asked": asked}]

    return folded(events, InOrder("began_us long, asked_us long", step, idle_s), (opened, polled, *closed), "event_id long, asked boolean", late)


def reviews(events: DataFrame, paused: str, resumed: dict[str, str], ttl_s: int = 86_400, late: str = "1 day") -> DataFrame:
    """event_id, outcome, by_event of each pause of a thread (``records.reviews``): a thread that is paused waits for one of the
    events of ``resumed``, which gives the outcome; a further pause replaces the one that waits, and after ``ttl_s`` it is
    expired, which a timer finds without any event."""

    def step(state, event, kind, us):
        out = [] if state is None else [{"event_id": state[0], "outcome": "replaced" if kind == paused else resumed[kind], "by_event": event}]
        return ((event, us) if kind == paused else None), out

    def ended(state, us):
        over = state[1] + ttl_s * 1_000_000 < us + 1
        return (None, [{"event_id": state[0], "outcome": "expired", "by_event": None}]) if over else (state, [])

    processor = InOrder("event_id long, paused_us long", step, 10 * 365 * 86_400, ended, lambda state: state[1] + ttl_s * 1_000_000)
    return folded(events, processor, (paused, *resumed), "event_id long, outcome string, by_event long", late)


def write_once(rows: DataFrame, path: str, checkpoint: str):
    """A writer of the stream's rows as Parquet, a folder for each trigger, which a trigger that runs again overwrites."""
    return rows.writeStream.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{path}/trigger={number}")).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
