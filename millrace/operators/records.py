"""Sampling, label reports, conversations, name lookup, review events, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import render as R
from ..functions import text as T
from . import substring


#: Ranges of a label's rows, each ranked by a task of its own.
RANGES = 4096


def balanced_sample(df: DataFrame, label: str, seq: str, limit: int) -> DataFrame:
    """Evenly spaced rows of every label (the empty text for none), min(total, limit) each, in the order of ``seq`` (a long).

    Rows are ranked within ranges of ``seq``, and counts of the ranges tell how many lie before: a label that holds a third of all rows is no single sort.
    """
    ends = df.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"))
    span = (F.col("hi").cast("double") - F.col("lo").cast("double")) / RANGES + 1e-9
    part = F.least(F.floor((F.col(seq).cast("double") - F.col("lo").cast("double")) / span), F.lit(RANGES - 1))
    rows = df.crossJoin(F.broadcast(ends)).withColumn("part", F.coalesce(part, F.lit(-1))).drop("lo", "hi").withColumn("owner", F.coalesce(label, F.lit("")))
    w = Window.partitionBy("owner")
    counts = rows.groupBy("owner", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(w.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(w)).drop("n")
    k = F.row_number().over(Window.partitionBy("owner", "part").orderBy(seq))
    ranked = rows.withColumn("inside", k).join(counts, ["owner", "part"]).withColumn("k", F.col("before") + F.col("inside"))
    return ranked.where(F.expr(f"(k * least(total, {limit})) div total > ((k - 1) * least(total, {limit})) div total")).select(*df.columns)


def head_sample(df: DataFrame, seq: str, n: int, text: str = "text") -> DataFrame:
    """First n non-blank records in the order of ``seq`` (an operator whose purpose is the limit)."""
    return df.where(F.regexp_replace(text, "(?U)\\s+", "") != "").orderBy(seq).limit(n)


def label_balance(df: DataFrame, label: Column, baseline: DataFrame) -> DataFrame:
    """label, cnt, base, trend against (label, base)."""
    counts = df.groupBy(F.when(F.coalesce(label, F.lit("")) == "", "(空标签)").otherwise(label).alias("label")).agg(F.count("*").alias("cnt"))
    trend = F.when(F.col("base").isNull(), "-").when(F.col("cnt") > F.col("base"), "回升").when(F.col("cnt") == F.col("base"), "未回升").otherwise("下降")
    return counts.join(F.broadcast(baseline), "label", "left").select("label", "cnt", "base", trend.alias("trend"))


def last_messages(conversations: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.where(F.col("role").isin("user", "assistant")).withColumn("back", F.row_number().over(w).cast("long")).where(F.col("back") <= n)


def latest(conversations: DataFrame) -> DataFrame:
    """conv_id, question (last of the user), answer (last non-empty of the assistant)."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    reply = F.when((F.col("role") == "assistant") & (F.col("text") != ""), F.col("turn"))
    return conversations.groupBy("conv_id").agg(F.max_by("text", user).alias("question"), F.max_by("text", reply).alias("answer"))


def cascade_lookup(names: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query, tier, name, n_hits: exact names, else names that hold the query, else names that the query holds (see ``substring.lookup``)."""
    asked = queries.select(F.col("query").alias("id"), "query").dropDuplicates(["id"])
    return substring.lookup(names, asked, k).withColumnRenamed("id", "query")


def pending_queue(events: DataFrame, opened: str, closed: tuple[str, ...]) -> DataFrame:
    """user_id, event_id, ts of each key's latest opening that no closing event follows."""
    order = F.struct("ts", "event_id")
    last = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == opened, order)).alias("o"), F.max(F.when(F.col("event_type").isin(*closed), order)).alias("c"))
    return last.where("o is not null and (c is null or c < o)").select("user_id", "o.event_id", "o.ts")


def by_department(queue: DataFrame, department: str | None) -> DataFrame:
    """The queue's items (current_department), of one department if one is named."""
    return queue if department is None else queue.where(F.col("current_department") == department)


def transfers(events: DataFrame, opened: str, moved: str, most: int = 2) -> DataFrame:
    """Transfers of each opened item: number within the item and whether accepted (at most ``most``)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    item = F.sum((F.col("event_type") == opened).cast("int")).over(w)
    rows = events.where(F.col("event_type").isin(opened, moved)).withColumn("item", item).where((F.col("event_type") == moved) & (F.col("item") > 0))
    n = F.row_number().over(Window.partitionBy("user_id", "item").orderBy("ts", "event_id"))
    return rows.select("user_id", "item", "event_id", n.cast("long").alias("n"), (n <= most).alias("accepted"))


def transfer_log(items: DataFrame, requests: DataFrame, most: int = 2) -> DataFrame:
    """The requests (thread_id, seq, target) on items (thread_id, department) with status (missing, limit, target, ok), and for
    those accepted the department before and after: the item moves, its review goes on waiting."""
    known = items.select("thread_id", "department")
    w = Window.partitionBy("thread_id").orderBy("seq")
    named = F.coalesce(F.col("target"), F.lit("")) != ""
    rows = requests.join(known, "thread_id", "left").withColumn("before", F.coalesce(F.sum(named.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    status = F.when(F.col("department").isNull(), "missing").when(F.col("before") >= most, "limit").when(~named, "target").otherwise("ok")
    rows = rows.withColumn("status", status)
    last = F.last(F.when(F.col("status") == "ok", F.col("target")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ok = F.col("status") == "ok"
    return rows.select("thread_id", "seq", "status", F.when(ok, F.coalesce(last, F.col("department"))).alias("from_department"), F.when(ok, F.col("target")).alias("to_department"))


def token_confirms(events: DataFrame, issued: str, confirmed: str, ttl_s: int = 600, password: Column | None = None, least: int = 6) -> DataFrame:
    """Each confirmation's outcome: ok, expired, invalid (none issued, or used already), or, where the password is given, short:
    that doesn't use the token up; success and expiry do."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    token = F.last(F.when(F.col("event_type") == issued, F.col("ts")), True).over(w)
    number = F.sum((F.col("event_type") == issued).cast("int")).over(w)
    short = F.lit(False) if password is None else F.length(F.coalesce(password, F.lit(""))) < least
    rows = events.where(F.col("event_type").isin(issued, confirmed)).withColumn("short", short).withColumn("token", token).withColumn("number", number).where(F.col("event_type") == confirmed)
    late = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("token").cast("timestamp")) > ttl_s * 1000000
    rows = rows.withColumn("late", late).withColumn("uses", (F.col("late") | ~F.col("short")).cast("int"))
    before = F.coalesce(F.sum("uses").over(Window.partitionBy("user_id", "number").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outcome = F.when(F.col("token").isNull() | (before > 0), "invalid").when(F.col("late"), "expired").when(F.col("short"), "short").otherwise("ok")
    return rows.select("user_id", "event_id", outcome.alias("outcome"))


def reviews(events: DataFrame, paused: str, resumed: dict[str, str], ttl_s: int = 86_400) -> DataFrame:
    """user_id, event_id, outcome, by_event of each pause: by the next event that resumes (its value) or pauses again (replaced), expired
    if that comes more than ``ttl_s`` later, or waiting if there is none."""
    rows = events.where(F.col("event_type").isin(paused, *resumed))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = F.lead(F.struct("event_id", "event_type", "ts")).over(w)
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = rows.withColumn("next", after).where(F.col("event_type") == paused)
    late = at("next.ts") - at("ts") > ttl_s * 1000000
    value = F.create_map(*[F.lit(x) for pair in resumed.items() for x in pair])
    outcome = F.when(F.col("next").isNull(), "waiting").when(late, "expired").when(F.col("next.event_type") == paused, "replaced").otherwise(F.try_element_at(value, F.col("next.event_type")))
    return rows.select("user_id", "event_id", outcome.alias("outcome"), F.when(~late, F.col("next.event_id")).alias("by_event"))


def review(drafts: DataFrame, enabled: bool = True) -> DataFrame:
    """Final text and status of a reviewed draft; anything but approve and revise is a rejection. Without review, drafts pass as they are."""
    if not enabled:
        return drafts.select("id", F.col("draft").alias("final"), F.lit("auto_approved").alias("status"))
    sign = R.sign_off(F.col("name"), F.col("dept"), F.col("title"))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    final = (
        F.when(F.col("action") == "approve", F.concat(F.coalesce(given("patient_summary"), "draft"), sign))
        .when(F.col("action") == "revise", F.concat(F.coalesce("revised", F.lit("")), sign))
        .otherwise(F.coalesce(given("revised"), F.lit(R.REJECT_FALLBACK)))
    )
    return drafts.select("id", final.alias("final"), F.when(F.col("action") == "approve", "approved").when(F.col("action") == "revise", "revised").otherwise("rejected").alias("status"))


# Where a call of a tool leads, first match counts; tools of the outside system.
ROUTES = (("retrieve", "consult"), ("kg_query", "generate_kg"), ("drug_taboo", "generate_drug"))
OUTSIDE = ("query_department", "query_registration", "query_lab_report")


def tool_route(threads: DataFrame) -> DataFrame:
    """id, route of threads (id, messages: array of (role, tools: array of names)): by the tools of the last assistant message that has any; end if none."""
    calls = F.filter("messages", lambda m: (m["role"] == "assistant") & (F.size(m["tools"]) > 0))
    names = F.try_element_at(calls, F.lit(-1))["tools"]
    route = F.when(names.isNull(), "end")
    for tool, to in ROUTES:
        route = route.when(F.array_contains(names, tool), to)
    route = route.when(F.arrays_overlap(names, F.array(*map(F.lit, OUTSIDE))), "generate_his").otherwise("generate_qa")
    return threads.select("id", route.alias("route"))


def poll_backoff(events: DataFrame, opened: str, polled: str, closed: tuple[str, ...], fast_s: int = 3, slow_s: int = 20, window_s: int = 180) -> DataFrame:
    """event_id, asked of each poll while an item waits: polls closer to the last one that asked than the interval are skipped;
    the interval is short for the first ``window_s`` seconds of waiting. A waiting item's polls are folded in order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    rows = events.where(kind.isin(opened, polled, *closed)).withColumn("item", F.sum((kind == opened).cast("int")).over(w))
    rows = rows.withColumn("ended", F.max(kind.isin(*closed).cast("int")).over(Window.partitionBy("user_id", "item").orderBy("ts", "event_id")))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    waits = rows.where("item > 0 and ended = 0").groupBy("user_id", "item").agg(F.min(micros).alias("began"), F.array_sort(F.collect_list(F.when(kind == polled, F.struct(micros.alias("t"), "event_id")))).alias("polls"))

    def step(state: Column, p: Column) -> Column:
        interval = F.when(p["t"] - F.col("began") < window_s * 1000000, fast_s * 1000000).otherwise(slow_s * 1000000)
        asked = state["last"].isNull() | (p["t"] - state["last"] >= interval)
        return F.struct(F.when(asked, p["t"]).otherwise(state["last"]).alias("last"), F.concat(state["out"], F.array(F.struct(p["event_id"].alias("event_id"), asked.alias("asked")))).alias("out"))

    empty = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<event_id:bigint,asked:boolean>>").alias("out"))
    return waits.select(F.explode(F.aggregate("polls", empty, step, lambda s: s["out"])).alias("e")).select("e.event_id", "e.asked")


def memories(messages: DataFrame, word: str = "记住") -> DataFrame:
    """user_id, seq, data: messages (user_id, seq, text) that ask to be remembered, escaped."""
    return messages.withColumn("data", T.remembered(F.col("text"), word)).where("data is not null").select("user_id", "seq", "data")


def append_messages(held: DataFrame, new: DataFrame) -> DataFrame:
    """(thread_id, turn, role, text) with the new (thread_id, seq, role, text) after each thread's last turn."""
    last = held.groupBy("thread_id").agg(F.max("turn").alias("last"))
    turn = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("thread_id").orderBy("seq"))
    return held.select("thread_id", "turn", "role", "text").unionByName(new.join(last, "thread_id", "left").select("thread_id", turn.cast("long").alias("turn"), "role", "text"))
