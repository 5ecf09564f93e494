"""All queries of the engine by name, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, records, retrieval

KG_ROWS = [
    (1, "糖尿病的就诊科室是什么", "内科；内分泌科"), (2, "糖尿病的症状是什么", "多尿；多饮；空腹血糖≥7.0mmol/L"), (3, "多尿是什么疾病的症状", "糖尿病；前列腺增生"),
    (4, "糖尿病的并发症", "糖尿病足；酮症酸中毒"), (5, "糖尿病足的就诊科室", "外科"), (6, "下肢动脉栓塞术的并发症", "血栓"),
    (7, "糖尿病的药物治疗", "二甲双胍；胰岛素；二甲双胍"), (8, "糖尿病的治疗", "病因：无；饮食控制"), (9, "糖尿病有哪些症状", "乏力"),
]
CLEAN_ROWS = [(1, "头疼失眠半个月", "心理科学"), (2, "头疼失眠焦虑", "心理科学"), (3, "高血压的诊断标准", "内科"), (4, "肚子疼", "其他"), (5, "咳嗽三天", "内科")]
MASK_ROWS = [(1, "我是王小明先生，住阳光花园3号楼，电话13800138000"), (2, "中关村路88号"), (3, "113800138000"), (4, "1234567890123456789室"), (5, None)]
SAFE_ROWS = [(1, "你得了胃炎"), (2, "不能确诊"), (3, "我不想活了"), (4, "")]
SAFE_WORDS = {"danger": ("suicide", "kill myself", "hurt myself", "want to die", "poison"), "diagnostic": ("you have been diagnosed", "you certainly have", "you must have")}
SYMPTOM_ROWS = [("感觉异常",), ("血糖升高",), ("神经元凋亡",), ("HbA1c",), ("痛",), ("头晕",)]
DRUG_ROWS = [("强力脑清素片禁忌症是什么？",), ("平地木的用药禁忌是什么?",), ("饮食禁忌",), ("感冒怎么办",)]
REVIEW_ROWS = [(1, "approve", "草稿", "摘要", None, "王伟", "内科", "主治医师"), (2, "revise", "草稿", None, "改稿", "李雷", "外科", "主任医师"), (3, "reject", "草稿", None, None, "张三", "儿科", "医师")]
TERMS = ["the", "and", "license", "erhe"]
LOOKUPS = ["red widget", "widget", "a small ring set", "no such thing"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(rows: list[tuple], columns: str) -> str:
    """The rows as a SQL relation, for the equivalents."""
    lit = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as v({columns})"


def _neighbours(spark, d, k=20):
    vectors = _t(spark, d, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors, retrieval.knn(vectors, queries, k)


def knn_topk(spark, d):
    return _neighbours(spark, d)[1].select("query_id", "vec_id", "label", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


def prior_distribution(spark, d):
    return retrieval.prior(_t(spark, d, "embeddings"))


def triage_vote(spark, d):
    return retrieval.vote(_neighbours(spark, d)[1], prior_distribution(spark, d))


def label_examples(spark, d):
    """The nearest document of each label; a query has a few of them, so texts are joined to those alone."""
    ids = _t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"))
    first = _neighbours(spark, d)[1].join(ids, "vec_id", "left_semi").groupBy("query_id", "label").agg(F.min_by("vec_id", "rank").alias("vec_id"))
    return first.join(_t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select("query_id", "label", F.left("text", F.lit(100)).alias("example"))


def consult_filtered_knn(spark, d):
    vectors = _t(spark, d, "embeddings")
    top = triage_vote(spark, d).where("place <= 3").select("query_id", F.col("label").alias("query_label"))
    queries = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).join(top, "query_id")
    return retrieval.knn(vectors, queries, 10, filter_label=True).select("query_id", "label", "vec_id", F.col("rank").cast("long").alias("rank"))


def bm25_stats(spark, d):
    return retrieval.bm25_stats(_t(spark, d, "documents"))[0].select("tok", "df", F.round("idf", 6).alias("idf"))


def bm25_search(spark, d):
    return retrieval.bm25_search(_t(spark, d, "documents"), TERMS)


def rrf_fusion(spark, d):
    words = bm25_search(spark, d).select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").alias("key"), "rank")
    vectors = knn_topk(spark, d).where("query_id = 0").select("query_id", F.col("vec_id").alias("key"), "rank")
    return retrieval.fuse([words, vectors])


def rrf_fusion_queries(spark, d):
    """Every id divisible by 100 is a query, by the text of that document and by that vector; each of the two lists counts where it is."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    words = retrieval.bm25_queries(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))
    return retrieval.fuse([words.select("query_id", F.col("doc_id").alias("key"), "rank"), knn_topk(spark, d).select("query_id", F.col("vec_id").alias("key"), "rank")])


def retrieval_eval(spark, d):
    vectors, near = _neighbours(spark, d)
    expected = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.array("label").alias("expected"))
    return retrieval.metrics(near.select("query_id", "rank", "label"), expected)


def balanced_sample(spark, d):
    return records.balanced_sample(_t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 100)


def head_sample(spark, d):
    return records.head_sample(_t(spark, d, "documents"), "doc_id", 50).select("doc_id", "source")


def truncate_documents(spark, d):
    t = T.truncate(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", t.alias("t")).where("t <> ''").select("doc_id", F.length("t").cast("long").alias("n"), F.sha2(F.col("t").cast("binary"), 256).alias("sha256"))


def label_balance(spark, d):
    base = spark.createDataFrame([("src0", 50), ("src1", 40), ("src2", 600)], "label string, base long")
    return records.label_balance(_t(spark, d, "documents"), F.col("source"), base)


def cleaning(spark, d):
    df = spark.createDataFrame(CLEAN_ROWS, "id long, question string, label string")
    return df.select("id", T.is_template(F.col("question")).alias("template"), T.correct_label(F.col("question"), F.col("label")).alias("label"), F.col("label").isin(*T.INVALID_LABELS).alias("invalid"))


def pii_mask(spark, d):
    masked, hits = T.mask(F.col("text"))
    return spark.createDataFrame(MASK_ROWS, "id long, text string").select("id", masked.alias("masked"), hits.cast("long").alias("hits"))


def pii_mask_documents(spark, d):
    masked, hits = T.mask(F.col("text"), (r"[0-9]{16}", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+"))
    return _t(spark, d, "documents").select("doc_id", F.md5(masked.cast("binary")).alias("masked_md5"), hits.cast("long").alias("hits"))


def safety_flags(spark, d):
    return spark.createDataFrame(SAFE_ROWS, "id long, text string").select("id", F.array_join(T.safety_flags(F.col("text")), ",").alias("flags"))


def safety_flags_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(T.safety_flags(F.lower("text"), **SAFE_WORDS), ",").alias("flags"))


def symptom_validity(spark, d):
    return spark.createDataFrame(SYMPTOM_ROWS, "name string").select("name", T.valid_symptom(F.col("name")).alias("valid"))


def drug_candidates(spark, d):
    return spark.createDataFrame(DRUG_ROWS, "question string").where(T.is_drug_taboo(F.col("question"))).select("question", T.drug_name(F.col("question")).alias("drug_name"))


def _kg(spark):
    return graph.triples(spark.createDataFrame(KG_ROWS, "seq long, question string, answer string"))


def kg_triples(spark, d):
    return _kg(spark).select("head", "pred", "tail", "cnt")


def kg_nodes(spark, d):
    return graph.nodes(_kg(spark))


def kg_stats(spark, d):
    return graph.stats(_kg(spark))


def _star(spark, d):
    part = _t(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    li = _t(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    a = li.select(F.col("p_brand").alias("head"), F.lit("symptom_of").alias("pred"), F.col("p_name").alias("tail"))
    b = li.select(F.col("p_name").alias("head"), F.lit("has_drug").alias("pred"), F.col("l_suppkey").cast("string").alias("tail"))
    t = a.unionByName(b).groupBy("head", "pred", "tail").agg(F.count("*").alias("cnt"))
    return t.withColumn("first_seq", F.concat_ws("|", "pred", "head", "tail"))


def kg_triples_star(spark, d):
    return _star(spark, d).select("head", "pred", "tail", "cnt")


def kg_nodes_star(spark, d):
    """A name has one type here, whichever triple comes first."""
    return graph.nodes(_star(spark, d).withColumn("first_seq", F.lit(0).cast("long")))


def kg_stats_star(spark, d):
    return graph.stats(_star(spark, d))


def kg_two_hop(spark, d):
    tr = _star(spark, d)
    return graph.two_hop(tr, tr.where("pred = 'symptom_of'").select(F.col("head").alias("start")).distinct(), branch=3)


def kg_two_hop_defaults(spark, d):
    tr = _star(spark, d)
    return graph.two_hop(tr, tr.where("pred = 'symptom_of'").select(F.col("head").alias("start")).distinct())


def cascade_lookup(spark, d):
    names = _t(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return records.cascade_lookup(names, spark.createDataFrame([(q,) for q in LOOKUPS], "query string"))


def last_messages(spark, d):
    return records.last_messages(_t(spark, d, "conversations")).select("conv_id", "turn", "role", "back")


def latest_messages(spark, d):
    return records.latest(_t(spark, d, "conversations"))


def pending_queue(spark, d):
    return records.pending_queue(_t(spark, d, "events"), "signup", ("purchase", "error")).select("user_id", "event_id")


def transfer_cap(spark, d):
    return records.transfers(_t(spark, d, "events"), "signup", "click").select("event_id", "n", "accepted")


def token_ttl(spark, d):
    return records.token_confirms(_t(spark, d, "events"), "signup", "click").select("event_id", "outcome")


def review_outcomes(spark, d):
    """A signup waits for review for a day, a purchase approves, an error rejects."""
    return records.reviews(_t(spark, d, "events"), "signup", {"purchase": "approved", "error": "rejected"}).select("event_id", "outcome", "by_event")


def review_decision(spark, d):
    return records.review(spark.createDataFrame(REVIEW_ROWS, "id long, action string, draft string, patient_summary string, revised string, name string, dept string, title string"))


def audit_timeline(spark, d):
    return _t(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("date").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


_KNN = """nb as (select q.vec_id as query_id, e.vec_id, e.label, round(list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - q.embedding[i]::double) ** 2)), 9) as dist from embeddings e, embeddings q where q.vec_id % 100 = 0 and e.vec_id <> q.vec_id),
nn as (select * from (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from nb) where rank <= 20),
pr as (select label, count(*) as prior from embeddings group by 1)"""
_VOTE = _KNN + """, vo as (select query_id, label, cnt, score, row_number() over (partition by query_id order by score desc, fr) as place from (
  select query_id, c.label, cnt, fr, cnt * cnt / (20 * prior / (select sum(prior) from pr)::double) as score from (select query_id, label, count(*) as cnt, min(rank) as fr from nn group by 1, 2) c join pr on c.label = pr.label))"""
_TOK = """tk as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents), p as (select doc_id, tok, count(*) as tf, any_value(dl) as dl from (select doc_id, len(t) as dl, unnest(t) as tok from tk) group by 1, 2),
sz as (select count(*) as n, avg(len(t)) as avgdl from tk), ra as (select tok, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from p, sz group by tok),
id as (select tok, df, case when raw < 0 then 0.25 * (select avg(raw) from ra) else raw end as idf from ra)"""
_BM = _TOK + f""", bm as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from (select doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from p join id using (tok), sz where tok in ({', '.join(f"'{t}'" for t in TERMS)}) group by 1) order by 3 limit 20)"""
_STAR = """li as (select p_brand, p_name, l_suppkey::varchar as supp from lineitem join part on l_partkey = p_partkey),
t as (select p_brand as head, 'symptom_of' as pred, p_name as tail, count(*) as cnt from li group by 1, 2, 3 union all select p_name, 'has_drug', supp, count(*) from li group by 1, 2, 3)"""
_ANY = lambda words: "|".join(w.replace("(", "\\(") for w in words)
_EV = "user_id order by ts, event_id"


def vote_sql() -> str:
    return f"with {_VOTE} select query_id, label, cnt, round(score, 6) as score, round(score / sum(score) over (partition by query_id), 6) as confidence, place from vo where place <= 5"


def balance_sql() -> str:
    return "select label, cnt, base, case when base is null then '-' when cnt > base then '回升' when cnt = base then '未回升' else '下降' end as trend from (select case when coalesce(source, '') = '' then '(空标签)' else source end as label, count(*) as cnt from documents group by 1) left join (values ('src0', 50::bigint), ('src1', 40), ('src2', 600)) as b(label, base) using (label)"


def oracle_sql() -> dict[str, str]:
    return {
        "knn_topk": f"with {_KNN} select query_id, vec_id, label, round(dist, 6) as dist, rank from nn",
        "prior_distribution": "select label, count(*) as prior from embeddings group by 1",
        "triage_vote": vote_sql(),
        "label_examples": f"with {_KNN} select query_id, label, left(arg_min(text, rank), 100) as example from nn join documents on doc_id = vec_id group by 1, 2",
        "consult_filtered_knn": f"with {_VOTE} select query_id, label, vec_id, rank from (select nb.query_id, nb.label, vec_id, row_number() over (partition by nb.query_id, nb.label order by dist, vec_id) as rank from nb join vo on vo.query_id = nb.query_id and vo.label = nb.label and place <= 3) where rank <= 10",
        "bm25_stats": f"with {_TOK} select tok, df, round(idf, 6) as idf from id",
        "bm25_search": f"with {_BM} select doc_id, score, rank from bm where score > 0",
        "rrf_fusion": f"with {_BM}, {_KNN}, u as (select doc_id as key, rank, 0 as l from bm where score > 0 union all select vec_id, rank, 1 from nn where query_id = 0), f as (select key, sum(1.0::double / (60 + rank)) as s, min(l * 1000 + rank) as seen from u group by 1) select 0::bigint as query_id, key, round(s, 9) as score, row_number() over (order by round(s, 12) desc, seen, key) as place from f",
        "rrf_fusion_queries": f"with {_TOK}, {_KNN}, bq as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from (select q.doc_id as query_id, p.doc_id, round(sum(q.tf * idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / avgdl))), 6) as score from p q join p on p.tok = q.tok and p.doc_id <> q.doc_id join id on id.tok = q.tok, sz where q.doc_id % 100 = 0 group by 1, 2)), u as (select query_id, doc_id as key, rank, 0 as l from bq where rank <= 20 and score > 0 union all select query_id, vec_id, rank, 1 from nn), f as (select query_id, key, sum(1.0::double / (60 + rank)) as s, min(l * 1000 + rank) as seen from u group by 1, 2) select query_id, key, round(s, 9) as score, row_number() over (partition by query_id order by round(s, 12) desc, seen, key) as place from f",
        "retrieval_eval": f"with {_KNN}, b as (select q.vec_id, min(case when nn.label = q.label then rank end) as r from embeddings q left join nn on nn.query_id = q.vec_id where q.vec_id % 100 = 0 group by 1) select count(*) as cases, round_even(avg((coalesce(r, 99) <= 1)::int), 4) as hit1, round_even(avg((coalesce(r, 99) <= 3)::int), 4) as hit3, round_even(avg((coalesce(r, 99) <= 5)::int), 4) as hit5, round_even(avg(coalesce(1.0::double / r, 0)), 4) as mrr, round_even(avg((r is null)::int), 4) as miss from b",
        "balanced_sample": "select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as k, count(*) over (partition by lang) as t from documents) where (k * least(t, 100)) // t > ((k - 1) * least(t, 100)) // t",
        "head_sample": "select doc_id, source from documents where regexp_matches(text, '\\S') order by doc_id limit 50",
        "truncate_documents": "select doc_id, length(t) as n, sha256(t) as sha256 from (select doc_id, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1500) as t from documents) where t <> ''",
        "label_balance": balance_sql(),
        "cleaning": f"select id::bigint as id, regexp_matches(question, '{_ANY(T.TEMPLATE_HINTS)}') as template, case when label = '心理科学' and regexp_matches(question, '头疼|头痛') and question like '%失眠%' and not regexp_matches(question, '{_ANY(T.MENTAL_HINTS)}') then '神经科学' else label end as label, label in ('其他', '未知科室') as invalid from {_values(CLEAN_ROWS, 'id, question, label')}",
        "pii_mask_documents": "select doc_id, md5(regexp_replace(m, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+', '***', 'g')) as masked_md5, coalesce(len(regexp_extract_all(text, '[0-9]{16}')) + len(regexp_extract_all(m, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]+')), 0)::bigint as hits from (select doc_id, text, regexp_replace(text, '[0-9]{16}', '***', 'g') as m from documents)",
        "safety_flags": f"select id::bigint as id, concat_ws(',', case when regexp_matches(text, '{_ANY(T.DANGER)}') then '危险信号' end, case when regexp_matches(text, '{_ANY(T.DIAGNOSTIC)}') then '诊断性表述' end) as flags from {_values(SAFE_ROWS, 'id, text')}",
        "safety_flags_documents": f"select doc_id, concat_ws(',', case when regexp_matches(lower(text), '{_ANY(SAFE_WORDS['danger'])}') then '危险信号' end, case when regexp_matches(lower(text), '{_ANY(SAFE_WORDS['diagnostic'])}') then '诊断性表述' end) as flags from documents",
        "symptom_validity": f"select name, length(name) between 2 and 12 and not regexp_matches(name, '[A-Za-z0-9≥≤><%.．/+°℃()（）~～=＝-]') and (name in ('感觉异常', '行为异常', '月经异常') or not regexp_matches(name, '{_ANY(T.PATHOLOGY_WORDS)}|({_ANY(T.BAD_SYMPTOM_SUFFIXES)})$')) as valid from {_values(SYMPTOM_ROWS, 'name')}",
        "kg_triples_star": f"with {_STAR} select head, pred, tail, cnt from t",
        "kg_nodes_star": f"with {_STAR} select name, type, sum(cnt)::bigint as count, sum(indeg)::bigint as symptom_indegree from (select head as name, case pred when 'symptom_of' then 'symptom' else 'disease' end as type, cnt, 0 as indeg from t union all select tail, case pred when 'symptom_of' then 'disease' else 'drug' end, cnt, (pred = 'symptom_of')::int from t) group by 1, 2",
        "kg_stats_star": f"with {_STAR} select pred, count(*) as triples, count(distinct head) as heads, count(distinct tail) as tails, sum(cnt)::bigint as instances from t group by 1",
        "kg_two_hop": "with li as (select p_brand, p_name, l_suppkey from lineitem join part on l_partkey = p_partkey), s as (select p_brand as head, p_name as tail, count(*) as cnt from li group by 1, 2), g as (select p_name as head, l_suppkey::varchar as tail, count(*) as cnt from li group by 1, 2), ind as (select tail, count(*) as i from s group by 1), h as (select head as start, s.tail as disease, round(cnt / (1 + 0.5 * ln(1 + i)), 6) as score, row_number() over (partition by head order by round(cnt / (1 + 0.5 * ln(1 + i)), 6) desc, s.tail) as place from s join ind on s.tail = ind.tail) select start, disease, score, place, 'has_drug' as relation, name, cnt from (select h.*, g.tail as name, g.cnt, row_number() over (partition by start, disease order by g.cnt desc, g.tail) as r from h join g on g.head = disease where place <= 3) where r <= 3",
        "kg_two_hop_defaults": "with li as (select p_brand, p_name, l_suppkey from lineitem join part on l_partkey = p_partkey), s as (select p_brand as head, p_name as tail, count(*) as cnt from li group by 1, 2), g as (select p_name as head, l_suppkey::varchar as tail, count(*) as cnt from li group by 1, 2), ind as (select tail, count(*) as i from s group by 1), h as (select head as start, s.tail as disease, round(cnt / (1 + 0.5 * ln(1 + i)), 6) as score, row_number() over (partition by head order by round(cnt / (1 + 0.5 * ln(1 + i)), 6) desc, s.tail) as place from s join ind on s.tail = ind.tail) select start, disease, score, place, 'has_drug' as relation, name, cnt from (select h.*, g.tail as name, g.cnt, row_number() over (partition by start, disease order by g.cnt desc, g.tail) as r from h join g on g.head = disease where place <= 5) where r <= 20",
        "cascade_lookup": f"with n as (select distinct p_name as name from part), c as (select query, name, case when trim(name) = trim(query) then 1 when contains(name, query) then 2 when contains(query, name) then 3 end as tier from n, {_values([(q,) for q in LOOKUPS], 'query')}), m as (select *, min(tier) over (partition by query) as l from c where tier is not null) select query, tier::bigint as tier, name, n_hits from (select query, tier, name, count(*) over (partition by query) as n_hits, row_number() over (partition by query order by name) as r from m where tier = l) where r <= 5",
        "last_messages": "select conv_id, turn, role, back from (select *, row_number() over (partition by conv_id order by turn desc) as back from conversations where role in ('user', 'assistant')) where back <= 5",
        "latest_messages": "select conv_id, arg_max(text, turn) filter (role = 'user') as question, arg_max(text, turn) filter (role = 'assistant' and text <> '') as answer from conversations group by 1",
        "pending_queue": "select user_id, event_id from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events where event_type in ('signup', 'purchase', 'error')) where r = 1 and event_type = 'signup'",
        "transfer_cap": f"select event_id, n, n <= 2 as accepted from (select event_id, row_number() over (partition by user_id, item order by ts, event_id) as n from (select *, sum((event_type = 'signup')::int) over (partition by {_EV}) as item from events) where event_type = 'click' and item > 0)",
        "token_ttl": f"select event_id, case when token is null or nth > 1 then 'invalid' when epoch_us(ts) - epoch_us(token) > 600000000 then 'expired' else 'ok' end as outcome from (select *, row_number() over (partition by user_id, num order by ts, event_id) as nth from (select *, max(case when event_type = 'signup' then ts end) over (partition by {_EV}) as token, sum((event_type = 'signup')::int) over (partition by {_EV}) as num from events) where event_type = 'click')",
        "review_outcomes": f"select event_id, case when n is null then 'waiting' when late then 'expired' when k = 'signup' then 'replaced' when k = 'purchase' then 'approved' else 'rejected' end as outcome, case when not late then n end as by_event from (select *, epoch_us(t) - epoch_us(ts) > 86400000000 as late from (select event_id, event_type, ts, lead(event_id) over w as n, lead(event_type) over w as k, lead(ts) over w as t from events where event_type in ('signup', 'purchase', 'error') window w as (partition by {_EV}))) where event_type = 'signup'",
        "audit_timeline": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (
        triage_vote, knn_topk, prior_distribution, label_examples, consult_filtered_knn, bm25_stats, bm25_search, rrf_fusion, rrf_fusion_queries, retrieval_eval,
        balanced_sample, head_sample, truncate_documents, label_balance, cleaning, pii_mask, pii_mask_documents, safety_flags, safety_flags_documents, symptom_validity,
        drug_candidates, kg_triples, kg_nodes, kg_stats, kg_triples_star, kg_nodes_star, kg_stats_star, kg_two_hop, kg_two_hop_defaults, cascade_lookup, last_messages, latest_messages, pending_queue, transfer_cap, token_ttl, review_outcomes, review_decision, audit_timeline,
    )
    return {f.__name__: f for f in fs}
