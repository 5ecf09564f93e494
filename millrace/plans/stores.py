"""Queries that ask a model, keep a keyed table, grow a graph or number lines, all in the shared folder, and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, graph_state, model_stage, reports
from ..sources import keyed, lines, shared
from . import catalogue as C

#: A text with more numbers than this is one on which the stand-in for a model fails.
MOST_NUMBERS = 8
LABELS = ("de", "en", "fr", "es")


def numbers_model(batch: list[dict]) -> list:
    """Stands for a model with structured output: the different numbers of four digits, in order; it fails on texts without words and with too many."""
    def one(text):
        if text is None or not re.search("[a-z]", text):
            raise ValueError("no words")
        found = sorted(set(re.findall("[0-9]{4}", text)))
        if len(found) > MOST_NUMBERS:
            raise ValueError("too many numbers")
        return {"items": found, "chars": len(text)}

    if len(batch) > 1:  # as a service does that refuses a batch for one of its rows
        return [_caught(one, r["text"]) for r in batch]
    return [one(batch[0]["text"])]


def _caught(one: Callable, text) -> dict | Exception:
    try:
        return one(text)
    except ValueError as e:
        return e


def _extracted(spark, d):
    docs = C._t(spark, d, "documents").select("doc_id", "text")
    return model_stage.applied(docs, ["text"], numbers_model, "items array<string>, chars long", shared.folder(spark, "extractions"), "numbers")


def structured_extract(spark, d):
    """Every document's numbers, or why there are none."""
    return _extracted(spark, d).select("doc_id", F.array_join("result.items", ",").alias("items"), F.col("result.chars").alias("chars"), "error")


def structured_extract_stats(spark, d):
    return reports.extraction_stats(_extracted(spark, d).select(F.col("result.items").alias("items"), "error"))


def language_judge(batch: list[dict]) -> list:
    """Stands for an auditor: a label of its list is approved if the source's name is known; a missing one is a failure."""
    out = []
    for r in batch:
        if r["corrected_label"] is None:
            out.append(ValueError("no label"))
        else:
            fine = r["corrected_label"] in LABELS
            out.append({"approved": fine, "authoritative_label": r["corrected_label"] if fine else r["original_label"], "reason": "listed" if fine else "not listed"})
    return out


def label_verdicts(spark, d):
    """Each document's language, put to the auditor as a correction of its source; equal corrections are asked once."""
    samples = C._t(spark, d, "documents").select("doc_id", F.col("source").alias("original_label"), F.col("lang").alias("corrected_label"))
    out = model_stage.audited(samples, language_judge, shared.folder(spark, "verdicts"), "listed", inputs=("original_label", "corrected_label"))
    return out.select("doc_id", "approved", "authoritative_label", "reason")


def keyed_events(spark, d):
    """Each user's last event, from upserts by kind of event, so out of the order of time; an error removes the user."""
    table = keyed.KeyedTable(spark, shared.folder(spark, "keyed"), "user_id long, ts timestamp, event_id long, event_type string", ["user_id"], ["ts", "event_id"])
    events = C._t(spark, d, "events")
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy(F.desc("event_type")).limit(8).collect()]
    for n, kind in enumerate([*kinds, None]):
        rows = events.where(F.col("event_type").eqNullSafe(kind)) if kind is not None else events.where(F.col("event_type").isNull() | ~F.col("event_type").isin(*kinds))
        table.upsert(rows.withColumn(keyed.DELETED, F.coalesce(F.col("event_type") == "error", F.lit(False))), n)
    table.compact()
    return table.read().select("user_id", "event_id", "event_type")


def _grown(spark, d):
    part = C._t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    sold = C._t(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_linenumber", seq.alias("seq"), F.concat("p_name", F.lit("的推荐药")).alias("question"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("answer"))
    known = part.where("p_size > 10").select((-F.col("p_partkey")).alias("seq"), F.concat("p_name", F.lit("的就诊科室")).alias("question"), F.concat(F.lit("d"), F.col("p_size").cast("string")).alias("answer"))
    state = graph_state.GraphState(spark, shared.folder(spark, "graph"))
    # the later half first, and the seeds last of all
    state.add(sold.where("l_linenumber > 2").drop("l_linenumber"), 1)
    state.add(sold.where("l_linenumber <= 2").drop("l_linenumber"), 2)
    state.add(known, 3)
    state.compact(2)
    return state


def kg_grown_triples(spark, d):
    """Triples of parts, their suppliers and sizes, from a graph that took its records in three batches."""
    return _grown(spark, d).triples()


def kg_grown_nodes(spark, d):
    return graph.nodes(_grown(spark, d).triples()).select("name", "type", "count", "symptom_indegree")


def numbered_lines(spark, d):
    """Every document's place in files of JSON lines that are written in the order of ids."""
    path = shared.folder(spark, "lines")
    docs = C._t(spark, d, "documents").select("doc_id", "text")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.json(path)
    return lines.records(spark, path, "doc_id long, text string").select("doc_id", "seq", F.length("text").cast("long").alias("chars"))


def oracle_sql() -> dict[str, str]:
    found = "list_sort(list_distinct(regexp_extract_all(text, '[0-9]{4}')))"
    wrong = f"case when text is null or not regexp_matches(text, '[a-z]') then 'ValueError: no words' when len({found}) > {MOST_NUMBERS} then 'ValueError: too many numbers' end"
    records_ = "select replace(p_name, ' ', '') as head, 'has_drug' as pred, 's' || l_suppkey as tail, (l_orderkey * 10 + l_linenumber) * 1000000 as o from lineitem join part on l_partkey = p_partkey union all select replace(p_name, ' ', ''), 'belongs_to_department', 'd' || p_size, -p_partkey * 1000000 from part where p_size > 10"
    grown = f"r as ({records_}), t as (select head, pred, tail, count(*) as cnt, min(o) as first_seq from r where head in (select head from r where pred = 'belongs_to_department') group by 1, 2, 3)"
    return {
        "structured_extract": f"select doc_id, case when error is null then array_to_string(items, ',') end as items, case when error is null then length(text) end as chars, error from (select doc_id, text, {found} as items, {wrong} as error from documents)",
        "structured_extract_stats": f"select count(*) as candidates, count(*) filter (error is null) as ok, count(error) as failed, count(*) filter (error is null and n = 0) as empty, coalesce(round_even(avg(n) filter (error is null), 2), 0) as mean_items from (select len({found}) as n, {wrong} as error from documents)",
        "label_verdicts": f"select doc_id, coalesce(lang in {LABELS!r}, false) as approved, case when lang in {LABELS!r} then lang else source end as authoritative_label, case when lang is null then '审核异常: ValueError: no label' when lang in {LABELS!r} then 'listed' else 'not listed' end as reason from documents",
        "keyed_events": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 and event_type is distinct from 'error'",
        "kg_grown_triples": f"with {grown} select head, pred, tail, cnt, first_seq from t",
        "kg_grown_nodes": f"with {grown}, e as (select head as name, 'disease' as type, first_seq * 2 as o, cnt from t union all select tail, case pred when 'has_drug' then 'drug' else 'department' end, first_seq * 2 + 1, cnt from t) select name, arg_min(type, o) as type, sum(cnt)::bigint as count, 0::bigint as symptom_indegree from e group by 1",
        "numbered_lines": "select doc_id, row_number() over (order by doc_id) - 1 as seq, length(text) as chars from documents",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (structured_extract, structured_extract_stats, label_verdicts, keyed_events, kg_grown_triples, kg_grown_nodes, numbered_lines)}
