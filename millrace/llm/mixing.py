"""Mixing sources to target weights by weighted fair queueing.

Documents queue per source in a fixed shuffled order (md5 of the id), each source's queue running
twice. A document's virtual finish time is the words its source has sent by then, itself included,
divided by the source's target; the mix takes documents in order of finish time, over all sources,
until the total budget is spent. The document at the border is cut to what is left.

Sums within a source are taken over 4096 hash ranges of each source: a table of range totals gives
every range its offset, so that no task sees more than one range of a source. The border is found in
the same way over ranges of finish time; only the range that holds it is sorted.

(The mix is the prefix of all entries in order of finish time, as a global range-sort and truncation
at the budget would give; a range histogram finds the same border without moving the entries.)

Only the named columns are read. Ties of finish time go by queue and place. Long texts count whole.
Null texts have no words, a null source is a source like others and comes last; documents without
words are never taken; documents with one id, null ids among them, are told apart by their sizes and
otherwise interchangeable. An empty table gives no rows; with no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Ranges of a unit of virtual time.
TICKS = 4096


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Adds weight and target to (source, source_size): water-filling under the limit of ``repeats`` times the size.

    In order of limit over weight, a source is at its limit if the level that would be left for it and
    all after it lies above; one level then holds for the rest. A row per source; one task.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy(repeats * F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("long")
    limit = repeats * F.col("source_size")
    before = by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sources.withColumn("weight", weight)
    out = out.withColumn("budget", share * F.sum("source_size").over(every).cast("double"))
    out = out.withColumn("capped_before", F.sum(limit).over(before) - limit).withColumn("weights_left", F.sum("weight").over(every) - F.sum("weight").over(before) + F.col("weight"))
    out = out.withColumn("capped", limit < (F.col("budget") - F.col("capped_before")) / F.col("weights_left") * F.col("weight"))
    capped = F.sum(F.when(F.col("capped"), limit).otherwise(0)).over(every)
    rest = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    level = (F.col("budget") - capped) / rest
    return out.withColumn("target", F.when(F.col("capped"), limit.cast("double")).otherwise(F.coalesce(level * F.col("weight"), F.lit(0.0)))).select("source", "source_size", "weight", "target")


def words(text: str) -> Column:
    """The size of a document."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document of (doc_id, text, source)."""
    spark = docs.sparkSession
    size = words("text")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = common.save(docs.select("doc_id", "source", size.alias("size"), key.alias("queue"), order.alias("h")).withColumn("range", F.substring("h", 1, 3)), "mix-sizes")
    ranges = rows.groupBy("source", "queue", "range").agg(F.sum("size").alias("range_size"))
    sources = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, repeats)
    ahead = Window.partitionBy("queue").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = (
        ranges.withColumn("offset", F.sum("range_size").over(ahead) - F.col("range_size"))
        .join(sources.withColumn("queue", key).drop("source"), "queue")
        .select("queue", "range", "offset", "source_size", "target")
    )
    within = Window.partitionBy("queue", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = common.save(
        rows.withColumn("inside", F.sum("size").over(within)).join(offsets, ["queue", "range"])
        .select("doc_id", "queue", "size", "source_size", "target", (F.col("offset") + F.col("inside")).alias("sent")), "mix-queues",
    )

    def finish(turn: int | Column) -> Column:
        return ((F.lit(turn) if isinstance(turn, int) else turn) * F.col("source_size") + F.col("sent")).cast("double") / F.col("target")

    entries = queued.where("size > 0 and target > 0").select("queue", "size", "sent", "source_size", "target", F.explode(F.array(*map(F.lit, range(repeats)))).alias("turn")).select("queue", "size", "sent", "turn", finish(F.col("turn")).alias("finish"))
    tick = F.when(F.col("finish") < 2, F.floor(F.col("finish") * TICKS)).otherwise(2 * TICKS + F.floor(F.log2("finish") * 16)).cast("long")
    entries = entries.withColumn("tick", tick)
    budget = sources.agg(F.floor(F.sum("target") + 1e-6).cast("long").alias("budget"))
    ticks = entries.groupBy("tick").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    border = ticks.crossJoin(F.broadcast(budget)).where("upto - n < budget and upto >= budget").select("tick", (F.col("upto") - F.col("n")).alias("base"), "budget")
    # the one range of finish times in which the budget runs out, in order; a single border row comes of it
    exact = Window.orderBy("finish", "queue", "sent", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        entries.join(F.broadcast(border), "tick").withColumn("upto", F.col("base") + F.sum("size").over(exact))
        .where("upto >= budget and upto - size < budget")
        .select(F.struct("finish", "queue", "sent", "turn").alias("last"), (F.col("size") - F.col("upto") + F.col("budget")).alias("part"))
    )
    last = last.agg(F.max("last").alias("last"), F.max("part").alias("part"))  # one row, also for empty input
    taken = sum(
        F.when(F.struct(finish(t).alias("finish"), "queue", "sent", F.lit(t).alias("turn")) < F.col("last"), F.col("size"))
        .when(F.struct(finish(t).alias("finish"), "queue", "sent", F.lit(t).alias("turn")) == F.col("last"), F.col("part"))
        .otherwise(0)
        for t in range(repeats)
    )
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.coalesce(taken, F.lit(0))).otherwise(0).cast("long")
    return queued.crossJoin(F.broadcast(last)).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '')) as h from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by 1),
named as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight from sources),
level0 as (select *, 1.5::double * (sum(source_size) over ())::double as budget,
    (sum(2 * source_size) over w - 2 * source_size)::double as capped_before, (sum(weight) over () - sum(weight) over w + weight)::double as weights_left
  from named window w as (order by (2 * source_size)::double / weight, source nulls last rows unbounded preceding)),
level1 as (select *, (2 * source_size)::double < (budget - capped_before) / weights_left * weight as capped from level0),
level2 as (select *, (sum(case when capped then 2 * source_size else 0 end) over ())::double as c, (sum(case when capped then 0 else weight end) over ())::double as r from level1),
targets as (select source, source_size, case when capped then (2 * source_size)::double else coalesce((budget - c) / nullif(r, 0) * weight, 0) end as target from level2),
queued as (select doc_id, size, source_size, target, coalesce('s' || s.source, 'n') as queue,
    (sum(size) over (partition by s.source order by h, doc_id, size rows unbounded preceding))::bigint as sent
  from sized s join targets t on s.source is not distinct from t.source),
entries as (select *, unnest([0, 1]) as turn from queued where size > 0 and target > 0),
finished as (select *, (turn * source_size + sent)::double / target as finish from entries),
mixed as (select *, (sum(size) over (order by finish, queue, sent, turn rows unbounded preceding))::bigint as upto, (select floor(sum(target) + 1e-6)::bigint from targets) as budget from finished),
taken as (select queue, sent, doc_id, sum(greatest(0, least(size, budget - upto + size)))::bigint as taken from mixed group by all)
select q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::bigint as taken
from queued q left join taken t on q.queue = t.queue and q.sent = t.sent and q.doc_id is not distinct from t.doc_id and q.size > 0
"""
