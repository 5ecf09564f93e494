"""Renderers, accounts, sinks, stand-ins for models, and streams, against tables derived by hand."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import render
from millrace.functions import text as T
from millrace.operators import accounts, graph, plug, records, reports
from millrace.plans import catalogue, workflow
from millrace.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


def test_answers(spark):
    assert one(spark, "One. Two\n\n\n  a ```x = 1. ``` b. c \n\nThree", render.paragraphs) == "One.\nTwo\n\na \n```\nx = 1.\n```\n b. c\n\nThree"
    assert one(spark, "<think>hm</think>yes ", render.thinking) == "**思考过程**：\nhm\n\n**最终回复**：\nyes"
    assert one(spark, "我想死", render.block_message) == render.DANGER_MESSAGE and one(spark, "头疼", render.block_message) is None and one(spark, None, render.block_message) is None
    assert one(spark, "你得了胃炎", render.with_hint) == "你得了胃炎\n\n" + render.DIAGNOSTIC_HINT and one(spark, "多喝水", render.with_hint) == "多喝水"
    texts = spark.createDataFrame([(["内科", "外科", "儿科"], "查血"), (["内科"], "等"), ([], "急")], "d array<string>, a string").select(render.triage_text(F.col("d"), F.col("a")).alias("t")).collect()
    assert [r.t for r in texts] == ["推荐科室：首选【内科】；备选：外科、儿科\n\n就医建议：查血", "推荐科室：首选【内科】\n\n就医建议：等", "推荐科室：（暂无法判断，请及时就医）\n\n就医建议：急"]
    assert one(spark, "b", lambda x: render.triage_draft(F.array(F.lit("内科")), F.lit("等"), x)).endswith("等\n\n【分诊依据】\nb")
    sign = spark.createDataFrame([("王伟", "内科", "主任"), ("王伟", None, ""), ("", "内科", "主任")], "n string, d string, t string").select(render.sign_off(F.col("n"), F.col("d"), F.col("t")).alias("s")).collect()
    assert [r.s for r in sign] == ["\n\n（本建议已由 内科·王医生（主任） 审核）", "\n\n（本建议已由 王医生 审核）", ""]


def test_parsing(spark):
    got = spark.createDataFrame([(["[急] 头疼"],), (['["a","b"]'],), (["[]"],), ([],), (["plain"],)], "q array<string>").select(T.first_question(F.col("q")).alias("x")).collect()
    assert [r.x for r in got] == ["[急] 头疼", "a", "", "", "plain"]
    assert one(spark, "\x1c　a b\x1f ", T.strip) == "a b" and one(spark, "a <b> & 记住", T.remembered) == "a &lt;b&gt; &amp; 记住" and one(spark, "a", T.remembered) is None
    with pytest.raises(ValueError):
        readers.parse(spark.range(1), "unheard of")
    assert readers.with_metadata(spark.createDataFrame([("d", "x", None)], "document string, label string, score int")).first().metadata == '{"label":"x"}'


def test_tool_texts(spark):
    answers = spark.createDataFrame([(1, 1, " a "), (1, 2, ""), (1, 3, "c"), (2, 1, None)], "query_id long, rank long, answer string")
    assert {r.query_id: r.text for r in render.numbered(answers).collect()} == {1: "1. a\n3. c", 2: render.NO_KNOWLEDGE}
    assert {r.query_id: r.text for r in render.consult_context(answers, 1).collect()}[1] == "-  \n- \n- c"
    votes = spark.createDataFrame([(1, "内科", 3, 0.625, 1), (1, "外科", 1, 0.375, 2)], "query_id long, label string, cnt long, confidence double, place long")
    examples = spark.createDataFrame([(1, "外科", 4, "y"), (1, "内科", 1, "x"), (1, "儿科", 2, "")], "query_id long, label string, rank long, example string")
    assert render.distribution(votes, examples).first().text == "候选科室分布（已按全库先验分布校准）：\n内科：3次（62%）；外科：1次（38%）\n代表病例摘要：\n- 内科：x\n- 外科：y"
    hops = graph.two_hop(catalogue._kg(spark), spark.createDataFrame([("多尿",)], "start string"), ranked=True)
    assert render.disease_lines(hops).first().text == "症状「多尿」可能关联的疾病（按相关性排序）：\n1. 糖尿病 | 科室：内科、内分泌科 | 药物：二甲双胍、胰岛素 | 治疗：饮食控制 | 伴随症状：多尿、多饮、空腹血糖≥7.0mmol/L"
    hits = spark.createDataFrame([("阿司", "阿司匹林", ["孕妇", "儿童"], 2), ("阿司", "阿司匹林栓", None, 2)], "query string, name string, items array<string>, n_hits long")
    assert render.taboo_lines(hits).first().text == "药物「阿司」的禁忌信息（共 2 条匹配）：\n- 【阿司匹林】孕妇；儿童\n- 【阿司匹林栓】（该药暂无明确禁忌记录）"


def test_entities(spark):
    tr = catalogue._kg(spark)
    asked = spark.createDataFrame([("多 尿", [1.0, 0.0]), ("尿多", [0.9, 0.1]), ("无关", [-1.0, 0.2]), ("甲亢", [0.0, 1.0])], "query string, vector array<double>")
    nodes = spark.createDataFrame([("多尿", [1.0, 0.0]), ("多饮", [0.0, 1.0])], "name string, vector array<double>")
    names = nodes.select("name").unionByName(spark.createDataFrame([("甲状腺功能亢进",)], "name string"))
    got = {r["query"]: (r.node, r.method) for r in graph.resolve(asked, names, nodes).collect()}
    assert got == {"多 尿": ("多尿", "exact"), "尿多": ("多尿", "nearest"), "无关": (None, None), "甲亢": ("甲状腺功能亢进", "alias")}
    cover = {r.disease: r for r in graph.coverage(tr, spark.createDataFrame([("糖尿病",), ("肺炎",)], "disease string")).collect()}
    assert cover["糖尿病"].covered and not cover["肺炎"].covered and not cover["肺炎"].symptoms
    near = graph.neighbors(tr, spark.createDataFrame([("糖尿病",)], "start string"), ("has_drug",)).collect()
    assert {r["tail"] for r in near} == {"二甲双胍", "胰岛素"}
    pairs = spark.createDataFrame([("冠状动脉粥样硬化性心脏病", "冠心病"), ("急性上消化道出血", "上消化道出血"), ("糖尿病", "肺炎")], "a string, b string")
    assert [r.x for r in pairs.select(graph.expected(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False]
    assert graph.kept_per_record(tr, spark.range(9)).first().kept == 1.44
    assert [r["name"] for r in graph.symptom_names(graph.nodes(tr)).collect()][:1] != []


def test_accounts(spark):
    got = spark.createDataFrame([("u1", "c@@2", "高", "内科")], "u string, c string, r string, d string").select(accounts.thread_id(F.col("u"), F.col("c")).alias("t"), accounts.queue_label(F.col("d"), F.col("r"), F.lit("0123456789")).alias("l"))
    got = got.withColumn("u", accounts.thread_user(F.col("t"))).withColumn("c", accounts.thread_conversation(F.col("t"))).first()
    assert (got.t, got.u, got.c, got.l) == ("u1@@c@@2", "u1", "c@@2", "[内科] 高 · 用户 01234567")
    assert set(accounts.public_profiles(spark.createDataFrame([("1", "s", "h")], "phone string, salt string, password_hash string")).columns) == {"phone"}
    assert len(one(spark, "pw", lambda x: accounts.hashed(x, F.lit("salt")))) == 64
    assert [r.label for r in accounts.conversation_list(spark.createDataFrame([(1, "t", "2024")], "conv_id long, title string, created string")).collect()] == ["t - 2024"]
    assert one(spark, "13800138000\n", accounts.phone_ok) and not one(spark, "138001380001", accounts.phone_ok) and not one(spark, None, accounts.phone_ok)


def test_states(spark):
    drafts = spark.createDataFrame([(1, "d")], "id long, draft string")
    assert records.review(drafts, enabled=False).first().status == "auto_approved"
    events = spark.createDataFrame([(1, 1, "i", 0, None), (1, 2, "c", 10, "12345"), (1, 3, "c", 20, "123456"), (1, 4, "c", 30, "123456"), (2, 5, "i", 0, None), (2, 6, "c", 700, "12345"), (2, 7, "c", 701, "123456"), (3, 8, "c", 1, "123456")], "user_id long, event_id long, event_type string, s long, pw string")
    events = events.withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.outcome for r in records.token_confirms(events, "i", "c", password=F.col("pw")).collect()}
    assert got == {2: "short", 3: "ok", 4: "invalid", 6: "expired", 7: "invalid", 8: "invalid"}
    queue = spark.createDataFrame([(1, "内科"), (2, "外科")], "id long, current_department string")
    assert records.by_department(queue, "内科").count() == 1 and records.by_department(queue, None).count() == 2
    held = spark.createDataFrame([("t", 1, "user", "a")], "thread_id string, turn long, role string, text string")
    new = spark.createDataFrame([("t", 5, "user", "c"), ("t", 4, "assistant", "b"), ("u", 1, "user", "x")], "thread_id string, seq long, role string, text string")
    assert sorted((r.thread_id, r.turn, r.text) for r in records.append_messages(held, new).collect()) == [("t", 1, "a"), ("t", 2, "b"), ("t", 3, "c"), ("u", 1, "x")]
    polls = spark.createDataFrame([(1, 1, "o", 0.0), *[(1, 2 + i, "p", s) for i, s in enumerate((1.0, 3.0, 4.0, 179.0, 180.0, 182.0, 199.0, 219.0))], (1, 20, "x", 300.0), (1, 21, "p", 301.0)], "user_id long, event_id long, event_type string, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.event_id: r.asked for r in records.poll_backoff(polls, "o", "p", ("x",)).collect()} == {2: True, 3: False, 4: True, 5: True, 6: False, 7: False, 8: True, 9: True}


def test_reports(spark):
    cases = spark.createDataFrame([(True, 1, 5, None), (True, 3, 4, None), (False, None, 1, None), (None, None, None, "x")], "hit boolean, rank int, quality int, error string")
    assert tuple(reports.judge_summary(cases).first()) == (3, 0.6667, 0.3333, 3.333, 2.0)
    found = spark.createDataFrame([("a", ["a", "b"], "d"), (None, ["c"], None)], "found string, acceptable array<string>, first string")
    assert tuple(reports.match_rate(found).first()) == (2, 1, 1)
    ten = spark.range(10)
    assert [r.id for r in reports.seeded_sample(ten, "id", 3, 7).collect()] == [r.id for r in reports.seeded_sample(ten.repartition(3), "id", 3, 7).collect()]
    assert {(r.k, r.v) for r in reports.first_of(spark.createDataFrame([(1, 3), (1, 2), (2, 5)], "k long, v long"), ["k"], "v").collect()} == {(1, 2), (2, 5)}


def test_sinks(spark, tmp_path):
    base, made = f"file://{tmp_path}", []
    rows = spark.createDataFrame([("d1", "s"), ("d2", "s"), ("d1", "s")], "document string, source string")
    for _ in range(2):
        sinks.write_collection(rows, f"{base}/c", "qa")
    sinks.write_collection(rows.where("document = 'd1'"), f"{base}/c", "other", clear=True)
    assert {(r.document, r.collection) for r in spark.read.parquet(f"{base}/c").collect()} == {("d1", "qa"), ("d2", "qa"), ("d1", "other")} and spark.read.parquet(f"{base}/c").count() == 3
    sinks.append_lines(sinks.audit_records(spark.createDataFrame([("t", "u")], "thread_id string, user_id string"), "transfer"), f"{base}/a")
    sinks.append_lines(sinks.audit_records(spark.createDataFrame([("t", "u")], "thread_id string, user_id string"), "final"), f"{base}/a")
    assert {r.event for r in spark.read.json(f"{base}/a").collect()} == {"transfer", "final"}
    sinks.store_objects(rows, f"{base}/o")
    assert sinks.load_objects(spark, f"{base}/o", "document string, source string").count() == 3
    sinks.write_report(rows.groupBy("source").count(), f"{base}/r")
    assert spark.read.json(f"{base}/r").first()["count"] == 3 and sinks.preview(rows).count() == 2

    def build():
        made.append(1)
        tr = catalogue._kg(spark)
        return {"nodes": graph.nodes(tr), "edges": graph.edges(tr)}

    for _ in range(2):
        assert sinks.cached(spark, f"{base}/g", build)["nodes"].count() == 11
    assert len(made) == 1
    names = rows.select(F.col("document").alias("name"))
    for _ in range(2):
        vectors = sinks.cached_vectors(names, f"{base}/v", plug.hashed_embedding)
    assert vectors.count() == 2 and len(vectors.first().vector) == 64


def test_models(spark):
    assert plug.audit(spark.range(3), lambda df: F.when(df["id"] > 0, df["id"] == 1)).orderBy("id").select("approved", "error").collect() == [(None, True), (True, False), (False, False)]
    rows = spark.createDataFrame([(1, "a b", i, t, i) for i, t in enumerate(["x", "a", "b a", "a c"])], "query_id long, query string, key long, text string, rank long")
    assert [r.key for r in plug.rerank(rows, 2).orderBy("place").collect()] == [2, 1] and [r.key for r in plug.rerank(rows, 2, enabled=False).orderBy("place").collect()] == [0, 1]
    assert [r.key for r in plug.rerank(rows, 9).orderBy("place").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("kind", ["transfer", "token", "audit"])
def test_streams(spark, tmp_path, kind):
    from millrace.streaming import twins

    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(1).sortWithinPartitions("ts", "event_id").write.parquet(f"file://{tmp_path}/in")
    stream, got = twins.event_stream(spark, f"file://{tmp_path}/in", batch.schema), []
    if kind == "audit":
        rows = stream.select(F.col("user_id").cast("string").alias("user_id"), "ts")
        twins.audit_sink(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/ck", "view").start().awaitTermination(120)
        assert spark.read.json(f"file://{tmp_path}/out").count() == batch.count()
        return
    out, want = (twins.transfer_cap_stream(stream, "signup", "click"), records.transfers(batch, "signup", "click").select("event_id", "n", "accepted")) if kind == "transfer" else (twins.token_ttl_stream(stream, "signup", "click"), records.token_confirms(batch, "signup", "click").select("event_id", "outcome"))
    out.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start().awaitTermination(120)
    assert sorted(got) == sorted(map(tuple, want.collect()))


def test_stream_counts(spark, tmp_path):
    from millrace.streaming import twins

    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(f"file://{tmp_path}/in")
    got = {}
    stream = twins.audit_counts(twins.event_stream(spark, f"file://{tmp_path}/in/*.parquet", batch.schema), late="3650 days")
    stream.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).foreachBatch(lambda df, _: got.update({(r.start, r.event_type): r.n for r in df.collect()})).start().awaitTermination(120)
    assert got == {(r.w.start, r.event_type): r.n for r in batch.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}


def test_readers_of_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"instruction": "hi", "input": "", "output": "yo"}]')
    df = readers.read(spark, f"file://{tmp_path}/a.json", readers.SCHEMAS["dialogue"])
    assert [r.document for r in readers.parse(df, "dialogue").collect()] == ["hi yo"]
    assert set(workflow.queries()) and df.count() == 1
