"""Column functions on text: cleaning rules, masking, safety checks, parsing. Rule tables are parameters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and patterns that results depend on.
TEMPLATE_HINTS = ("辅助治疗", "判断依据", "诊断标准", "鉴别诊断", "治疗原则", "护理措施", "发病机制", "临床表现")
MENTAL_HINTS = ("抑郁", "焦虑", "情绪", "心情", "压力", "烦躁", "郁闷", "紧张")
INVALID_LABELS = ("其他", "未知科室")
DANGER = ("自杀", "轻生", "自残", "割腕", "跳楼", "上吊", "服毒", "想死", "不想活", "活不下去", "杀人", "伤人", "报复社会", "制造爆炸", "买凶", "投毒", "自尽")
DIAGNOSTIC = ("确诊为", "确诊了", "可以确诊", "能够确诊", "基本确诊", "已确诊", "你得了", "你患了", "你一定是", "你肯定是", "你绝对是", "百分百是", "肯定是得了", "你一定是得了")
BAD_SYMPTOM_CHARS = "≥≤><%.．/\\+-℃°()（）~～=＝"
BAD_SYMPTOM_SUFFIXES = ("改变", "异常", "升高", "增高", "降低", "减低", "增多", "减少", "增加", "下降", "增厚", "变薄", "狭窄", "扩张", "阳性", "阴性", "水平", "缺失", "损害", "减退", "减弱", "增强", "加快", "减慢", "差")
PATHOLOGY_WORDS = ("病变", "沉积", "萎缩", "凋亡", "斑块", "坏死", "增生", "浸润", "纤维化", "钙化", "脱髓鞘", "变性", "退化", "缺损", "重建", "参数", "模型", "实验", "切片", "标本", "染色", "信号", "通路", "表达", "增殖", "分化", "受体", "基因", "因子", "含量", "浓度", "比值", "曲线", "测定", "检测", "范围")
SYMPTOM_ALLOWED = ("感觉异常", "行为异常", "月经异常")
MASKS = (
    r"(?<!\d)\d{17}[\dXx](?!\d)|(?<!\d)\d{15}(?!\d)",
    r"(?<!\d)1[3-9]\d{9}(?!\d)",
    r"[一-龥]{2,3}(?:先生|女士|小姐)",
    r"\d{1,4}(?:号楼|栋|单元|室|层)",
    r"(?:路|街|巷|弄|大道|胡同)\d{1,6}号?",
    r"[一-龥]{2,8}(?:小区|花园|苑|公寓|大厦|广场|新村)",
)
ALIASES = {"冠心病": "冠状动脉粥样硬化性心脏病", "甲亢": "甲状腺功能亢进", "哮喘": "支气管哮喘", "心梗": "心肌梗死", "脑梗": "脑梗死"}
DRUG_HINT = "药|片|胶囊|颗粒|丸|素|注射|口服|滴眼|软膏|溶液|糖浆|栓|喷雾|贴剂|混悬|糖衣|肠溶|缓释"
DRUG_TAIL = "(的用药|用药|有哪些|是什么|哪些|什么|是|有|的)+$"


def any_of(text: Column, words: Sequence[str]) -> Column:
    """True if the text holds one of the words; false for null."""
    return F.coalesce(text.rlike("|".join(map(re.escape, words))), F.lit(False))


def is_template(question: Column, words: Sequence[str] = TEMPLATE_HINTS) -> Column:
    return any_of(question, words)


def correct_label(question: Column, label: Column) -> Column:
    """Headache with sleeplessness and no word of mood, filed under psychology, belongs to neurology."""
    wrong = (label == "心理科学") & any_of(question, ("头疼", "头痛")) & any_of(question, ("失眠",)) & ~any_of(question, MENTAL_HINTS)
    return F.when(wrong, "神经科学").otherwise(label)


def valid_symptom(name: Column) -> Column:
    plain = ~name.rlike("[A-Za-z0-9" + re.escape(BAD_SYMPTOM_CHARS) + "]")
    natural = ~any_of(name, PATHOLOGY_WORDS) & ~name.rlike("(" + "|".join(BAD_SYMPTOM_SUFFIXES) + ")$")
    return F.length(name).between(2, 12) & plain & (name.isin(*SYMPTOM_ALLOWED) | natural)


def mask(text: Column, patterns: Sequence[str] = MASKS) -> tuple[Column, Column]:
    """(masked text, replacements): each pattern works on what the ones before left. Digits are Unicode digits."""
    hits = F.lit(0)
    for p in patterns:
        p = "(?U)" + p
        hits = hits + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, "***")
    return text, F.coalesce(hits, F.lit(0))


def safety_flags(text: Column, danger: Sequence[str] = DANGER, diagnostic: Sequence[str] = DIAGNOSTIC) -> Column:
    flags = F.array(F.when(any_of(text, danger), "危险信号"), F.when(any_of(text, diagnostic), "诊断性表述"))
    return F.filter(flags, lambda x: x.isNotNull())


def strip(text: Column, characters: str = "") -> Column:
    """Without Unicode white space (and any of the characters) at both ends."""
    c = f"[\\s\\x1c-\\x1f{re.escape(characters)}]"
    return F.regexp_replace(text, f"(?U)^{c}+|{c}+$", "")


def truncate(text: Column, most: int = 1500) -> Column:
    return F.left(strip(text), F.lit(most))


def first_question(questions: Column) -> Column:
    """First of ["q", ...] or of [["q", ...], ...] read as an array of strings; empty if there is none."""
    q = F.try_element_at(questions, F.lit(1))
    inner = F.from_json(q, "array<string>")
    nested = F.startswith(q, F.lit("[")) & inner.isNotNull()  # a question may begin with a bracket
    return F.coalesce(F.when(nested, F.try_element_at(inner, F.lit(1))).otherwise(q), F.lit(""))


def canonical(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The name that an alias stands for, else the name."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), name), name)


def normalized(name: Column) -> Column:
    """An entity's name without white space."""
    return F.regexp_replace(name, "(?U)[\\s\\x1c-\\x1f]+", "")


def remembered(question: Column, word: str = "记住") -> Column:
    """What to keep of a message that asks to be remembered: its text, escaped for HTML; else null."""
    out = question
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.when(F.contains(F.lower(question), F.lit(word)), out)


def drug_name(question: Column) -> Column:
    at = F.instr(question, "禁忌")
    head = F.when(at > 1, F.substring(question, F.lit(1), at - 1)).otherwise(question)
    return strip(F.regexp_replace(strip(head), DRUG_TAIL, ""), "。，？?：:、")


def is_drug_taboo(question: Column) -> Column:
    return F.coalesce(question.rlike(DRUG_HINT) & question.contains("禁忌"), F.lit(False))


def split_answer(answer: Column) -> Column:
    """Entities of an enumeration: trimmed, without filler and overlong ones, first occurrence kept."""
    parts = F.transform(F.split(answer, "[；;]"), lambda x: F.regexp_replace(strip(strip(x), "。.，,；; "), "^病因[：:]\\s*", ""))
    fine = F.filter(parts, lambda x: (x != "") & ~x.isin("无", "无特殊", "无特定人群", "暂无", "不详") & (F.length(x) <= 30))
    return F.array_distinct(fine)
