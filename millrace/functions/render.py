"""Column functions that lay out answers, and aggregates that render tool results as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Wordings that results depend on.
DANGER_MESSAGE = "很抱歉，我无法就此提供帮助。如果你正处于痛苦中或有伤害自己/他人的念头，请立即联系身边可信任的人，或拨打心理援助热线（如全国 24 小时心理援助热线 12356）寻求专业帮助。"
DIAGNOSTIC_HINT = "（以上内容仅为可能性参考，不能替代医生的诊断结论，请及时就医确诊。）"
REJECT_FALLBACK = "抱歉，该回复未通过安全审核，已拦截。如症状持续或加重，请及时就医。"
NO_CASES, NO_TRIAGE, NO_KNOWLEDGE, NO_DISEASES = "无相关病例", "未检索到相关分诊信息。", "未检索到相关医学知识。", "知识图谱中未检索到该症状对应的疾病信息。"


def block_message(question: Column, words=T.DANGER, message: str = DANGER_MESSAGE) -> Column:
    """The message that answers a dangerous question; null for others."""
    return F.when(T.any_of(question, words), message)


def with_hint(answer: Column, words=T.DIAGNOSTIC, hint: str = DIAGNOSTIC_HINT) -> Column:
    """The answer, followed by the hint if it states a diagnosis."""
    return F.when(T.any_of(answer, words), F.concat(answer, F.lit("\n\n"), F.lit(hint))).otherwise(answer)


def paragraphs(answer: Column) -> Column:
    """Paragraphs apart by one blank line: a sentence a line in plain ones, fences on lines of their own in those with code."""

    def fenced(p: Column) -> Column:
        parts = F.transform(F.split(p, "```"), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("\n```\n"), T.strip(x), F.lit("\n```\n"))).otherwise(x))
        return F.array_join(parts, "")

    each = F.transform(F.split(answer, "\n{2,}"), lambda p: T.strip(F.when(F.contains(p, F.lit("```")), fenced(p)).otherwise(F.replace(p, F.lit(". "), F.lit(".\n")))))
    return F.array_join(each, "\n\n")


def thinking(answer: Column) -> Column:
    """Thought and answer under headings, in place of the tags."""
    return T.strip(F.replace(F.replace(answer, F.lit("<think>"), F.lit("**思考过程**：\n")), F.lit("</think>"), F.lit("\n\n**最终回复**：\n")))


def triage_text(departments: Column, advice: Column) -> Column:
    """What the patient reads: the first department, the others, and the advice."""
    rest = F.array_join(F.slice(departments, 2, F.greatest(F.size(departments) - 1, F.lit(0))), "、")
    first = F.concat(F.lit("推荐科室：首选【"), F.try_element_at(departments, F.lit(1)), F.lit("】"), F.when(rest != "", F.concat(F.lit("；备选："), rest)).otherwise(""))
    return F.concat(F.when(F.size(departments) > 0, first).otherwise("推荐科室：（暂无法判断，请及时就医）"), F.lit("\n\n就医建议："), advice)


def triage_draft(departments: Column, advice: Column, basis: Column) -> Column:
    """What the doctor reads: the patient's text and its reasons."""
    return F.concat(triage_text(departments, advice), F.lit("\n\n【分诊依据】\n"), basis)


def sign_off(name: Column, department: Column, title: Column) -> Column:
    """The reviewer's line, by family name only; empty without a name."""
    core = F.concat(F.when(F.coalesce(department, F.lit("")) != "", F.concat(department, F.lit("·"))).otherwise(""), F.left(name, F.lit(1)), F.lit("医生"))
    core = F.concat(core, F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("（"), title, F.lit("）"))).otherwise(""))
    return F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("\n\n（本建议已由 "), core, F.lit(" 审核）"))).otherwise("")


def joined(rows: DataFrame, key: str, order: list[str], line: Column, by: str, most: int | None = None) -> DataFrame:
    """key, text: the lines of each key in this order (the first ``most``)."""
    held = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    lines = F.transform(held if most is None else F.slice(held, 1, most), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(lines, by).alias("text"))


def consult_context(answers: DataFrame, most: int = 80) -> DataFrame:
    """query_id, text: cut answers of (query_id, rank, answer) as a list."""
    return joined(answers, "query_id", ["rank"], F.concat(F.lit("- "), F.left(F.coalesce("answer", F.lit("")), F.lit(most))), "\n")


def distribution(votes: DataFrame, examples: DataFrame) -> DataFrame:
    """query_id, text: labels with counts and shares of (query_id, label, cnt, confidence, place), then the examples (query_id, label, rank, example)."""
    share = F.concat("label", F.lit("："), F.col("cnt").cast("string"), F.lit("次（"), F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%）"))
    head = joined(votes, "query_id", ["place"], share, "；")
    tail = joined(examples.where("example <> ''"), "query_id", ["rank", "label"], F.concat(F.lit("- "), "label", F.lit("："), "example"), "\n")
    more = F.coalesce(F.concat(F.lit("\n代表病例摘要：\n"), "more"), F.lit(""))
    return head.join(tail.withColumnRenamed("text", "more"), "query_id", "left").select("query_id", F.concat(F.lit("候选科室分布（已按全库先验分布校准）：\n"), "text", more).alias("text"))


def numbered(answers: DataFrame) -> DataFrame:
    """query_id, text: the non-empty answers of (query_id, rank, answer), by rank."""
    rows = answers.select("query_id", "rank", T.strip(F.coalesce("answer", F.lit(""))).alias("answer"))
    line = F.when(F.col("answer") != "", F.concat(F.col("rank").cast("string"), F.lit(". "), "answer"))
    held = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), lambda x: x.isNotNull())
    return rows.groupBy("query_id").agg(F.array_join(held, "\n").alias("text")).withColumn("text", F.when(F.col("text") == "", NO_KNOWLEDGE).otherwise(F.col("text")))


def disease_lines(hops: DataFrame) -> DataFrame:
    """start, text: a line per disease of ``graph.two_hop`` (ranked) with its departments, drugs, treatments and symptoms."""
    # Heading, relation and most names of each part, in this order.
    parts = (("科室", "belongs_to_department", 3), ("药物", "has_drug", 5), ("治疗", "has_treatment", 5), ("伴随症状", "has_symptom", 5))
    rows = hops.groupBy("start", "disease", "place").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.struct("r", "name")))).alias(r) for _, r, _ in parts
    ])
    seg = [F.when(F.size(r) > 0, F.concat(F.lit(f"{head}："), F.array_join(F.transform(F.slice(r, 1, n), lambda x: x["name"]), "、"))) for head, r, n in parts]
    line = F.concat_ws(" | ", F.concat(F.col("place").cast("string"), F.lit(". "), "disease"), *seg)
    out = joined(rows.withColumn("line", line), "start", ["place"], F.col("line"), "\n")
    return out.select("start", F.concat(F.lit("症状「"), "start", F.lit("」可能关联的疾病（按相关性排序）：\n"), "text").alias("text"))


def taboo_lines(hits: DataFrame) -> DataFrame:
    """query, text: drugs with their contraindications of (query, name, items, n_hits), as ``records.cascade_lookup`` cuts them."""
    items = F.array_join(F.coalesce("items", F.array().cast("array<string>")), "；")
    line = F.concat(F.lit("- 【"), "name", F.lit("】"), F.when(items == "", "（该药暂无明确禁忌记录）").otherwise(items))
    held = F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"])
    out = hits.groupBy("query").agg(F.max("n_hits").alias("n"), F.array_join(held, "\n").alias("text"))
    return out.select("query", F.concat(F.lit("药物「"), "query", F.lit("」的禁忌信息（共 "), F.col("n").cast("string"), F.lit(" 条匹配）：\n"), "text").alias("text"))
