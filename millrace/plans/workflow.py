"""Queries on parsing, entity resolution, reports, accounts and conversations, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..functions import text as T
from ..operators import accounts, graph, plug, records, reports, retrieval
from ..sources import readers
from . import catalogue as C

SOURCES = {
    "labelled": [("头疼失眠半个月", "多休息", "心理科学", 4, None), ("高血压的诊断标准", "略", "内科", None, None), ("肚子疼", "热敷", "其他", 1, "胃炎"), ("咳嗽三天", None, "内科", None, "肺炎"), ("", "空", "内科", 2, None)],
    "encyclopedia": [(['["q1","q1b"]'], ["a1", "a2"]), (["[急] 头疼怎么办"], ["喝水"]), ([], []), (["plain"], [])],
    "graph": [(["糖尿病的症状"], ["多尿", "", "多饮"]), (["[]"], [])],
    "dialogue": [("你好", "我头疼", "请描述"), (None, " 咳嗽 ", None), ("", "", "")],
}
THREADS = [
    (1, [("user", []), ("assistant", ["medical_qa", "kg_query"]), ("assistant", [])]), (2, [("assistant", ["retrieve"]), ("user", [])]), (3, [("user", [])]), (4, []),
    (5, [("assistant", ["drug_taboo"]), ("assistant", ["query_department"])]), (6, [("assistant", ["other"])]), (7, [("assistant", ["query_lab_report", "drug_taboo"])]),
]
ACCOUNTS = [("13900000002", "李雷", "内科", False, "s1", "h1"), ("admin", "管理员", None, True, "s2", "h2"), ("13900000001", "韩梅", "内科", False, "s3", "h3"), ("13700000001", "王伟", "", False, "s4", "h4"), ("13800000001", "赵六", "儿科", False, "s5", "h5")]
REQUESTS = [("13900000002", "重复", "内科", "secret1"), ("12900000002", "号码", "内科", "secret1"), ("13900000009", "  ", "内科", "secret1"), ("13900000008", "科室", "牙科", "secret1"), ("13900000007", "短码", "外科", "12345"), ("13900000006", "无误", "外科", "123456"), (None, "空", "外科", "123456")]
PLACES = ["内科", "儿科", "皮肤科", "牙科"]
TRIPLE_ALIASES = {"n100": "n1"}


def parse_qa_sources(spark, d):
    tables = {k: spark.createDataFrame(v, readers.SCHEMAS[k]) for k, v in SOURCES.items()}
    return readers.corpus(tables).select("source", "document", "answer", "label", "score", "related_diseases")


def relation_extract(spark, d):
    return graph.relations(spark.createDataFrame(C.KG_ROWS, "seq long, question string, answer string")).select("seq", "pred", "head")


def answer_split(spark, d):
    rows = spark.createDataFrame(C.KG_ROWS, "seq long, question string, answer string")
    return rows.select("seq", F.explode(T.split_answer(F.col("answer"))).alias("entity")).select("seq", T.normalized(F.col("entity")).alias("entity"))


def kg_edges(spark, d):
    return graph.edges(C._kg(spark))


def kg_coverage(spark, d):
    part = C._t(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    li = C._t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    li = li.withColumn("p_name", T.normalized(F.col("p_name")))
    a = li.select(F.col("p_name").alias("head"), F.lit("has_symptom").alias("pred"), F.col("p_brand").alias("tail"))
    b = li.where("l_quantity > 45").select(F.col("p_name").alias("head"), F.lit("has_drug").alias("pred"), F.col("l_suppkey").cast("string").alias("tail"))
    tr = a.unionByName(b).groupBy("head", "pred", "tail").agg(F.count("*").alias("cnt"))
    return graph.coverage(tr, part.select(F.col("p_name").alias("disease")).distinct())


def entity_resolve(spark, d):
    """Ids divisible by 100 ask; all but every second of them are nodes."""
    rows = C._t(spark, d, "embeddings").select("vec_id", F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vector"))
    nodes = rows.where("vec_id % 200 <> 100").select("name", "vector")
    return graph.resolve(rows.where("vec_id % 100 = 0").select(F.col("name").alias("query"), "vector"), nodes.select("name"), nodes, aliases=TRIPLE_ALIASES)


def judge_summary(spark, d):
    j = C._t(spark, d, "labels")
    return reports.judge_summary(j.select((F.col("quality") == 1).alias("hit"), (1 + F.col("doc_id") % 3).alias("rank"), (1 + F.col("doc_id") % 5).alias("quality"), F.when(F.col("toxic") == 1, "failed").alias("error")))


def cleaning_report(spark, d):
    wrong = (F.col("lang") == "en") & F.contains("text", F.lit("error"))
    return reports.cleaning_report(C._t(spark, d, "documents"), F.col("lang"), T.is_template(F.col("text"), ("license", "License")), F.when(wrong, "de").otherwise(F.col("lang")))


def balance_all_up(spark, d):
    return reports.all_up(C.label_balance(spark, d))


def audit_report(spark, d):
    samples = C._t(spark, d, "documents").select(F.col("doc_id").alias("id"))
    verdicts = plug.audit(C._t(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), lambda df: F.when(df["toxic"] == 0, df["quality"] == 1))
    return reports.audit_report(samples, verdicts.select("id", "approved", "error"))


def extraction_stats(spark, d):
    items = F.regexp_extract_all("text", F.lit("([0-9]{4})"), F.lit(1))
    return reports.extraction_stats(C._t(spark, d, "documents").select(items.alias("items"), F.when(F.col("n_chars") > 5000, "too long").alias("error")))


def tool_route(spark, d):
    return records.tool_route(spark.createDataFrame(THREADS, "id long, messages array<struct<role: string, tools: array<string>>>"))


def poll_backoff(spark, d):
    return records.poll_backoff(C._t(spark, d, "events"), "signup", "view", ("purchase", "error"))


def transfer_log(spark, d):
    events = C._t(spark, d, "events").select("user_id", "event_id", "event_type")
    items = events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("thread_id")).agg(F.lit("d0").alias("department"))
    asked = events.where("event_type = 'click'").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"))).alias("target"))
    return records.transfer_log(items, asked)


def memory_search(spark, d):
    """A user's memories are the vectors of one label; ids divisible by 100 ask."""
    vectors = C._t(spark, d, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    return retrieval.knn(vectors, queries, 3, filter_label=True).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def memory_store(spark, d):
    rows = C._t(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), "text")
    return records.memories(rows, "the").select("user_id", "seq", F.md5(F.col("data").cast("binary")).alias("data_md5"))


def conversation_titles(spark, d):
    return accounts.conversation_titles(C._t(spark, d, "conversations"))


def account_list(spark, d):
    return accounts.account_list(spark.createDataFrame(ACCOUNTS, "phone string, name string, department string, is_admin boolean, salt string, password_hash string"))


def account_status(spark, d):
    known = spark.createDataFrame(ACCOUNTS, "phone string, name string, department string, is_admin boolean, salt string, password_hash string")
    return accounts.account_status(spark.createDataFrame(REQUESTS, "phone string, name string, department string, password string"), known).select("name", "status")


def dim_lookup(spark, d):
    return accounts.lookup(spark.createDataFrame([(p,) for p in PLACES], "name string"), accounts.directory(spark))


def triage_distribution(spark, d):
    none = spark.createDataFrame([], "query_id long, label string, rank long, example string")
    return render.distribution(C.triage_vote(spark, d), none)


def consult_context(spark, d):
    near = C.consult_filtered_knn(spark, d).join(C._t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("answer")), "vec_id")
    return render.consult_context(near.withColumn("query_id", F.concat_ws(":", "query_id", "label")))


def rerank_candidates(spark, d):
    docs = C._t(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    found = C.bm25_search(spark, d).select(F.lit(0).cast("long").alias("query_id"), F.lit(" ".join(C.TERMS)).alias("query"), F.col("doc_id").alias("key"), "rank").join(docs, "key")
    return plug.rerank(found, 5).select("query_id", "key", F.round("score", 6).alias("score"), "place")


_RULES = [(pred, p) for pred, _, _, patterns in graph.RULES for p in patterns]
_VALID = lambda c: f"length({c}) between 2 and 12 and not regexp_matches({c}, '[A-Za-z0-9≥≤><%.．/+°℃()（）~～=＝-]') and ({c} in ('感觉异常', '行为异常', '月经异常') or not regexp_matches({c}, '{C._ANY(T.PATHOLOGY_WORDS)}|({C._ANY(T.BAD_SYMPTOM_SUFFIXES)})$'))"
_NORM = lambda c: f"regexp_replace({c}, '\\s+', '', 'g')"
_KG = f"""q as (select * from {C._values(C.KG_ROWS, 'seq, question, answer')}),
rel as (select *, trim(regexp_replace(h, '[的。，？? 可能会是：:]+$', '')) as head from (select seq, answer,
  case {' '.join(f"when regexp_matches(question, '{p}') then '{pred}'" for pred, p in _RULES)} end as pred,
  case {' '.join(f"when regexp_matches(question, '{p}') then regexp_extract(question, '^(.*?)(?:{p})', 1)" for _, p in _RULES)} end as h from q) where pred is not null),
cut as (select seq, e, min(pos) as pos from (select seq, regexp_replace(regexp_replace(x, '^[\\s。.，,；;]+|[\\s。.，,；;]+$', '', 'g'), '^病因[：:]\\s*', '') as e, pos
  from (select seq, unnest(string_split_regex(answer, '[；;]')) as x, generate_subscripts(string_split_regex(answer, '[；;]'), 1) as pos from q)) where e <> '' and e not in ('无', '无特殊', '无特定人群', '暂无', '不详') and length(e) <= 30 group by 1, 2),
flat as (select seq, pred, {_NORM('head')} as head, {_NORM('e')} as tail, pos from rel join cut using (seq) where head <> ''),
seeds as (select distinct {_NORM('head')} as s from rel where head <> '' and pred in ('belongs_to_department', 'has_complication') and not (pred = 'has_complication' and head like '%术%')),
kept as (select * from flat where case pred when 'symptom_of' then tail else head end in (select s from seeds) and (pred <> 'has_complication' or tail in (select s from seeds))),
tr as (select head, pred, tail, count(*) as cnt, min(o) as o from (select head, pred, tail, seq * 1000000 + pos * 2 as o from kept
  union all select tail, 'symptom_of', head, seq * 1000000 + pos * 2 + 1 from kept where pred = 'has_symptom' and {_VALID('tail')}) group by 1, 2, 3)"""
_TYPES = f"types as (select * from {C._values([(p, h, t) for p, h, t, _ in graph.RULES], 'pred, head_type, tail_type')})"
_MASK = (r"(^|\D)(\d{17}[\dXx]|\d{15})(\D|$)", r"(^|\D)(1[3-9]\d{9})(\D|$)", *T.MASKS[2:])
_STRIP = lambda c, more="": f"regexp_replace({c}, '^[\\s{more}]+|[\\s{more}]+$', '', 'g')"


def _masked() -> str:
    sql, hits = f"m0 as (select id::bigint as id, text as t, 0 as h from {C._values(C.MASK_ROWS, 'id, text')})", ""
    for i, p in enumerate(_MASK):
        new = r"\1***\3" if p.startswith("(^") else "***"
        sql += f", m{i + 1} as (select id, regexp_replace(t, '{p}', '{new}', 'g') as t, h + coalesce(len(regexp_extract_all(t, '{p}')), 0) as h from m{i})"
    return f"with {sql}{hits} select id, t as masked, h::bigint as hits from m{len(_MASK)}"


def _messages() -> str:
    lists = [f"({i}, {[{'role': r, 'tools': t} for r, t in m]!r}::struct(role varchar, tools varchar[])[])" for i, m in THREADS]
    return f"(values {', '.join(lists)}) as v(id, m)"


def _sources() -> str:
    arr = lambda x: f"{x!r}::varchar[]"
    pair = lambda rows: ", ".join(f"({arr(q)}, {arr(a)})" for q, a in rows)
    first = "coalesce(case when q[1] like '[%' and json_valid(q[1]) then q[1]::json->>0 else q[1] end, '')"
    wrong = f"label = '心理科学' and regexp_matches(question, '头疼|头痛') and question like '%失眠%' and not regexp_matches(question, '{C._ANY(T.MENTAL_HINTS)}')"
    none = "null as label, null::int as score, null as related_diseases"
    return f"""with l as (select *, coalesce(case when {wrong} then '神经科学' else label end, '') as new from {C._values(SOURCES['labelled'], 'question, answer, label, score, related_diseases')}),
e as (select {first} as q, coalesce(a[1], '') as a from (values {pair(SOURCES['encyclopedia'])}) as v(q, a)),
g as (select {first} as q, array_to_string(list_filter(a, lambda x: x <> ''), '；') as a from (values {pair(SOURCES['graph'])}) as v(q, a)),
u as (select 'labelled' as source, coalesce(question, '') as document, coalesce(answer, '') as answer, new as label, coalesce(score, 0)::int as score, coalesce(related_diseases, '') as related_diseases
  from l where not regexp_matches(question, '{C._ANY(T.TEMPLATE_HINTS)}') and new not in ('其他', '未知科室')
union all select 'encyclopedia', q || ' ' || a, a, {none} from e union all select 'graph', q || ' ' || coalesce(a, ''), coalesce(a, ''), {none} from g
union all select 'dialogue', trim(coalesce(i, '') || ' ' || coalesce(n, '')) || ' ' || coalesce(o, ''), o, {none} from {C._values(SOURCES['dialogue'], 'i, n, o')})
select source, left({_STRIP('document')}, 1500) as document, answer, label, score, related_diseases from u where {_STRIP('document')} <> ''"""


def oracle_sql() -> dict[str, str]:
    aliases = " ".join(f"when '{a}' then '{b}'" for a, b in TRIPLE_ALIASES.items())
    dot = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::double * {b}[i]::double))"
    norm = f"sqrt({dot.format(a='q.embedding', b='q.embedding')}) * sqrt({dot.format(a='e.embedding', b='e.embedding')})"
    accounts_ = C._values([(p, n, d, int(a)) for p, n, d, a, _, _ in ACCOUNTS], "phone, name, department, adm")
    routes = " ".join(f"when list_contains(t, '{a}') then '{b}'" for a, b in records.ROUTES)
    name_first = lambda c: f"'\n\n（本建议已由 ' || case when coalesce(dept, '') <> '' then dept || '·' else '' end || left(name, 1) || '医生' || case when coalesce(title, '') <> '' then '（' || title || '）' else '' end || ' 审核）'"  # noqa: E731, ARG005
    return {
        "parse_qa_sources": _sources(),
        "relation_extract": f"with {_KG} select seq::bigint as seq, pred, head from rel where head <> ''",
        "answer_split": f"with {_KG} select seq::bigint as seq, {_NORM('e')} as entity from cut",
        "kg_triples": f"with {_KG} select head, pred, tail, cnt from tr",
        "kg_edges": f"with {_KG} select head, tail, pred as relation, cnt as count from tr",
        "kg_stats": f"with {_KG} select pred, count(*) as triples, count(distinct head) as heads, count(distinct tail) as tails, sum(cnt)::bigint as instances from tr group by 1",
        "kg_nodes": f"with {_KG}, {_TYPES} select name, arg_min(type, o) as type, sum(cnt)::bigint as count, sum(i)::bigint as symptom_indegree from (select head as name, head_type as type, o * 2 as o, cnt, 0 as i from tr join types using (pred) union all select tail, tail_type, o * 2 + 1, cnt, (pred = 'symptom_of')::int from tr join types using (pred)) group by 1",
        "kg_coverage": "with li as (select regexp_replace(p_name, '\\s+', '', 'g') as node, l_quantity from lineitem join part on l_partkey = p_partkey), h as (select node, true as s, bool_or(l_quantity > 45) as d from li group by 1) select p.p_name as disease, node, coalesce(s, false) as symptoms, coalesce(d, false) as drugs, false as departments, false as treatments, coalesce(s and d, false) as covered from (select distinct p_name, regexp_replace(p_name, '\\s+', '', 'g') as node from part) p left join h using (node)",
        "entity_resolve": f"with q as (select vec_id, 'n' || vec_id as query, case 'n' || vec_id {aliases} else 'n' || vec_id end as node, embedding from embeddings where vec_id % 100 = 0), e as (select 'n' || vec_id as name, embedding from embeddings where vec_id % 200 <> 100), x as (select query, node, case when query = node then 'exact' else 'alias' end as method, null::double as sim from q where node in (select name from e)), s as (select query, name, round({dot.format(a='q.embedding', b='e.embedding')} / ({norm}), 6) as sim from q, e where query not in (select query from x)), b as (select *, row_number() over (partition by query order by sim desc, name) as r from s) select * from x union all select query, case when sim >= 0.6 then name end, case when sim >= 0.6 then 'nearest' end, case when sim >= 0.6 then sim end from b where r = 1",
        "judge_summary": "select count(*) as n, round_even(avg(coalesce(quality = 1, false)::int), 4) as hit_rate, round_even(avg((doc_id % 3 = 0)::int), 4) as top1_rate, round_even(avg(1 + doc_id % 5), 3) as mean_quality, coalesce(round_even(avg(1 + doc_id % 3) filter (quality = 1), 3), 0) as mean_rank from labels where toxic is distinct from 1",
        "cleaning_report": "select lang as label, count(*) as scanned, count(*) filter (t) as template_filtered, count(*) filter (not t and lang = 'en' and contains(text, 'error')) as corrected from (select lang, text, coalesce(regexp_matches(text, 'license|License'), false) as t from documents) group by 1",
        "balance_all_up": f"select coalesce(bool_and(cnt > base), true) as all_up from ({C.balance_sql()}) where base is not null",
        "audit_report": "select count(*) as audited, count(*) filter (toxic = 0 and quality = 1) as approved, count(*) filter (toxic = 0 and quality <> 1) as rejected, count(*) filter (toxic is distinct from 0 or quality is null) as error, round_even(count(*) filter (toxic = 0 and quality = 1) / count(*), 3) as approve_rate from documents left join labels using (doc_id)",
        "extraction_stats": "with i as (select coalesce(len(regexp_extract_all(text, '[0-9]{4}')), 0) as n, coalesce(n_chars > 5000, false) as bad from documents) select count(*) as candidates, count(*) filter (not bad) as ok, count(*) filter (bad) as failed, count(*) filter (not bad and n = 0) as empty, coalesce(round_even(avg(n) filter (not bad), 2), 0) as mean_items from i",
        "tool_route": f"select id::bigint as id, case when t is null then 'end' {routes} when list_has_any(t, {list(records.OUTSIDE)!r}) then 'generate_his' else 'generate_qa' end as route from (select id, list_filter(m, lambda x: x.role = 'assistant' and len(x.tools) > 0)[-1].tools as t from {_messages()})",
        "poll_backoff": f"""with recursive r as (select *, sum((event_type = 'signup')::int) over (partition by {C._EV}) as item from events where event_type in ('signup', 'view', 'purchase', 'error')),
w as (select *, epoch_us(ts) as t, max((event_type in ('purchase', 'error'))::int) over (partition by user_id, item order by ts, event_id) as ended from r where item > 0),
b as (select user_id, item, min(t) as began from w where ended = 0 group by 1, 2),
p as (select w.user_id, w.item, w.event_id, w.t, case when w.t - began < 180000000 then 3000000 else 20000000 end as i, row_number() over (partition by w.user_id, w.item order by w.t, w.event_id) as k from w join b using (user_id, item) where ended = 0 and event_type = 'view'),
f as (select user_id, item, k, event_id, true as asked, t as last from p where k = 1 union all select p.user_id, p.item, p.k, p.event_id, p.t - f.last >= p.i, case when p.t - f.last >= p.i then p.t else f.last end from f join p on p.user_id = f.user_id and p.item = f.item and p.k = f.k + 1)
select event_id, asked from f""",
        "transfer_log": "with i as (select distinct user_id from events where event_type = 'signup'), c as (select e.user_id as thread_id, event_id as seq, case when event_id % 3 > 0 then 'd' || event_id % 3 end as target, i.user_id as u from events e left join i on i.user_id = e.user_id where event_type = 'click'), b as (select *, coalesce(sum((target is not null)::int) over (partition by thread_id order by seq rows between unbounded preceding and 1 preceding), 0) as n from c), s as (select *, case when u is null then 'missing' when n >= 2 then 'limit' when target is null then 'target' else 'ok' end as status from b), l as (select *, max(case when status = 'ok' then seq end) over (partition by thread_id order by seq rows between unbounded preceding and 1 preceding) as prev from s) select l.thread_id, l.seq, l.status, case when l.status = 'ok' then coalesce(p.target, 'd0') end as from_department, case when l.status = 'ok' then l.target end as to_department from l left join s p on p.thread_id = l.thread_id and p.seq = l.prev",
        "memory_search": f"with {C._KNN} select query_id, vec_id, rank from (select nb.query_id, nb.vec_id, row_number() over (partition by nb.query_id order by dist, nb.vec_id) as rank from nb join embeddings q on q.vec_id = nb.query_id and q.label = nb.label) where rank <= 3",
        "memory_store": "select conv_id as user_id, turn as seq, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;')) as data_md5 from conversations where contains(lower(text), 'the')",
        "conversation_titles": "select conv_id, left(arg_min(text, turn), 20) as title from conversations group by 1",
        "account_list": f"select phone, name, department, adm = 1 as is_admin, row_number() over (order by 1 - adm, case when coalesce(department, '') = '' then '管理' else department end, phone) as place from {accounts_}",
        "account_status": f"select name, case when not coalesce(regexp_matches(phone, '^1[3-9][0-9]{{9}}$'), false) then 'phone' when trim(name) = '' then 'name' when department not in ({', '.join(map(repr, accounts.DEPARTMENTS))}) then 'department' when phone in ({', '.join(repr(a[0]) for a in ACCOUNTS)}) then 'exists' when length(password) < 6 then 'password' else 'ok' end as status from {C._values(REQUESTS, 'phone, name, department, password')}",
        "dim_lookup": f"select q.name, coalesce('科室「' || q.name || '」：医生 ' || doctors || ' 人，剩余号源 ' || slots || '，' || hours, '未找到科室「' || q.name || '」') as department, case when slots is null then '未找到科室「' || q.name || '」' when slots > 5 then '「' || q.name || '」当前剩余号源 ' || slots || ' 个（号源充足，可预约）' when slots > 0 then '「' || q.name || '」当前剩余号源 ' || slots || ' 个（号源紧张，建议尽快）' else '「' || q.name || '」今日号源已满' end as registration from {C._values([(p,) for p in PLACES], 'name').replace('as v', 'as q')} left join {C._values(list(accounts.DIRECTORY), 'name, doctors, slots, hours')} on v.name = q.name",
        "triage_distribution": f"with v as ({C.vote_sql()}) select query_id, '候选科室分布（已按全库先验分布校准）：' || chr(10) || string_agg(label || '：' || cnt || '次（' || round_even(confidence * 100, 0)::int || '%）', '；' order by place) as text from v group by 1",
        "consult_context": f"with {C._VOTE}, c as (select query_id, label, vec_id, rank from (select nb.query_id, nb.label, vec_id, row_number() over (partition by nb.query_id, nb.label order by dist, vec_id) as rank from nb join vo on vo.query_id = nb.query_id and vo.label = nb.label and place <= 3) where rank <= 10) select c.query_id || ':' || label as query_id, string_agg('- ' || left(coalesce(text, ''), 80), chr(10) order by rank) as text from c join documents on doc_id = vec_id group by 1",
        "rerank_candidates": f"with {C._BM}, c as (select doc_id, rank, len(list_intersect({C.TERMS!r}, regexp_extract_all(lower(text), '[a-z0-9]+'))) / {len(C.TERMS)} as s, count(*) over () as n from bm join documents using (doc_id) where score > 0) select 0::bigint as query_id, doc_id as key, round(case when n > 5 then s end, 6) as score, place from (select *, row_number() over (order by case when n > 5 then s end desc nulls last, rank) as place from c) where place <= 5",
        "pii_mask": _masked(),
        "drug_candidates": f"select question, {_STRIP('x', '。，？?：:、')} as drug_name from (select question, regexp_replace({_STRIP('h')}, '{T.DRUG_TAIL}', '') as x from (select question, case when strpos(question, '禁忌') > 1 then left(question, strpos(question, '禁忌') - 1) else question end as h from {C._values(C.DRUG_ROWS, 'question')} where regexp_matches(question, '{T.DRUG_HINT}') and contains(question, '禁忌')))",
        "review_decision": f"select id::bigint as id, case action when 'approve' then coalesce(nullif(patient_summary, ''), draft) || {name_first('x')} when 'revise' then coalesce(revised, '') || {name_first('x')} else coalesce(nullif(revised, ''), '{render.REJECT_FALLBACK}') end as final, case action when 'approve' then 'approved' when 'revise' then 'revised' else 'rejected' end as status from {C._values(C.REVIEW_ROWS, 'id, action, draft, patient_summary, revised, name, dept, title')}",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (
        parse_qa_sources, relation_extract, answer_split, kg_edges, kg_coverage, entity_resolve, judge_summary, cleaning_report, balance_all_up, audit_report, extraction_stats, tool_route,
        poll_backoff, transfer_log, memory_search, memory_store, conversation_titles, account_list, account_status, dim_lookup, triage_distribution, consult_context, rerank_candidates,
    )
    return {f.__name__: f for f in fs}
